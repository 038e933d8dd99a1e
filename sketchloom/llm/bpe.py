"""BPE encoding and decoding by batched merge rounds in numpy.

The symbols of many different words stand in one flat array. A round looks up the ranks of all neighbouring pairs by binary
search over the sorted pair keys (left * V + right), finds the lowest rank of every word, merges all its occurrences from
left to right, and compacts the array; words without a mergeable pair leave it. Rounds end when no word is left.

Merging all occurrences at once equals merging one at a time if a merge can never bring forth a pair of lower rank; this is
checked when the merges are loaded, and otherwise one occurrence is merged per word and round.

A null text counts as empty and has no tokens. The strings of special tokens in a text become their ids. Lone copies,
ties and repeated rows are encoded alike. The vocabulary file is a path parameter.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from .common import slices_of

NO_RANK = np.int32(2**31 - 1)
SLICE = 4_000_000
#: Beyond Latin letters and general punctuation, Unicode tables of different versions may tell letters apart differently.
SEPARATORS = re.compile("[\x1c-\x1f]")
UNUSUAL = re.compile("[^\x00-\x1b\x20-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .., for length[0] numbers, then the same from start[1], and so on."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + length, length)


class WordBpe:
    """A vocabulary with word ends, read from a tokenizer file: lower case, white space dropped, byte-level symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.size = np.uint32(max(self.tokens) + 1)
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], dtype=np.uint32)
        self.last = np.array([vocab[c + self.suffix] for c in alphabet], dtype=np.uint32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * int(self.size) + right
        order = np.argsort(keys, kind="stable")
        if self.size >= 1 << 16:
            raise ValueError("pair keys must fit 32 bits")
        self.keys, self.ranks, self.made = keys[order].astype(np.uint32), order.astype(np.int32), made[order].astype(np.uint32)
        born = np.full(int(self.size), -1, dtype=np.int64)
        np.maximum.at(born, made, np.arange(len(made)))
        self.all_at_once = bool((np.arange(len(made)) > np.maximum(born[left], born[right])).all())
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.exact_normal = tokenizers.Tokenizer.from_file(path).normalizer
        self.exact_split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.as_number = np.array([str(i) for i in range(int(self.size))], dtype=object)
        self.as_token = np.array([self.tokens.get(i, "") for i in range(int(self.size))], dtype=object)

    def normal(self, text: str) -> str:
        """NFC, then every character's lower case on its own (a final sigma is not special)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def plain_words(self, text: str) -> list[str]:
        """Words of a stretch without special tokens; unusual characters are classed by the tokenizer library's own tables."""
        if UNUSUAL.search(text):
            return [w for w, _ in self.exact_split.pre_tokenize_str(self.exact_normal.normalize_str(text))]
        return self.word.findall(self.normal(text))

    def words(self, text: str) -> list[str]:
        """Words in order; a special token inside the text stands in the list as its own string."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain_words(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.plain_words(part))]

    def ranks_at(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made symbol of each pair key (NO_RANK where there is no merge)."""
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.ranks[found], NO_RANK), self.made[found]

    def merge_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length): the ids of word w are ids[start[w] : start[w] + length[w]]. Words hold no white space and no special
        tokens. Ranks are kept between rounds; only pairs that touch a merged symbol are looked up again."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(b) for b in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sym, word = self.inner[data], np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        ends = np.cumsum(sizes)[sizes > 0] - 1
        sym[ends] = self.last[data[ends]]
        start, length_of, pieces, total = np.zeros(len(raw), dtype=np.int64), np.zeros(len(raw), dtype=np.int64), [np.zeros(0, np.uint32)], 0
        rank, made = self.ranks_at(sym * self.size + np.append(sym[1:], sym[:1]))
        rank[ends] = NO_RANK
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(first, len(sym)))
            lowest = np.minimum.reduceat(rank, first)
            done = lowest == NO_RANK
            if done.any():
                ended, n = np.repeat(done, length), length[done]
                pieces.append(sym[ended])
                at = word[first[done]]
                start[at], length_of[at] = total + np.cumsum(n) - n, n
                total += len(pieces[-1])
                stay = ~ended
                sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
                length, lowest = length[~done], lowest[~done]
                if not len(sym):
                    break
            places = np.flatnonzero(rank == np.repeat(lowest, length))
            if self.all_at_once:  # of overlapping pairs (one letter again and again) every second one counts
                begins = np.concatenate([[True], np.diff(places) > 1])
                run = np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run) % 2 == 0]
            else:
                places = places[np.concatenate([[True], np.diff(word[places]) > 0])]
            sym[places] = made[places]
            stay = np.ones(len(sym), dtype=bool)
            stay[places + 1] = False
            now = places - np.arange(len(places))
            sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
            touched = np.concatenate([now, now[now > 0] - 1])
            after = np.minimum(touched + 1, len(sym) - 1)
            rank[touched], made[touched] = self.ranks_at(sym[touched] * self.size + sym[after])
            rank[touched[(word[touched] != word[after]) | (after == touched)]] = NO_RANK
        return np.concatenate(pieces), start, length_of

    def merge_words(self, words: list[str]) -> list[tuple[int, ...]]:
        ids, start, length = self.merge_flat(words)
        return [tuple(ids[a : a + n].tolist()) for a, n in zip(start.tolist(), length.tolist(), strict=True)]

    def chunks(self, text: str) -> list[str]:
        """Stretches between white space, raw; no word spans two of them. Special tokens stand on their own. A text with
        control characters that Python takes for white space is one chunk."""
        if SEPARATORS.search(text):
            return [text]
        if self.cut is None or not any(s in text for s in self.special):
            return text.split()
        return [c for part in self.cut.split(text) for c in ([part] if part in self.special else part.split())]

    def split_chunks(self, chunks: list[str]) -> list[list[str]]:
        """Words of every raw chunk; what is plain in all of them is settled for all at once."""
        joined = "\n".join(chunks)
        if not chunks or UNUSUAL.search(joined) or any(s in joined for s in self.special):
            return [[c] if c in self.special else self.words(c) for c in chunks]
        lowered = self.normal(joined).split("\n")
        return [[c] if c.isalpha() else self.word.findall(c) for c in lowered]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges): the ids of text i are ids[edges[i] : edges[i + 1]]. Different chunks are split into words once, different words are merged
        once, all in one go; the texts' ids are then gathered from these."""
        number: dict[str, int] = {}
        listed = [[number.setdefault(c, len(number)) for c in self.chunks(t)] for t in texts]
        n_chunks = np.array([len(x) for x in listed], dtype=np.int64)
        in_text = np.fromiter(chain.from_iterable(listed), np.int64, int(n_chunks.sum()))
        split = self.split_chunks(list(number))
        n_words = np.array([len(x) for x in split], dtype=np.int64)
        known: dict[str, int] = {}
        in_chunk = np.array([known.setdefault(w, len(known)) for ws in split for w in ws], dtype=np.int64)
        own = [s for s in self.special if s in known]
        ids, start, length = self.merge_flat(["" if w in self.special else w for w in known] if own else list(known))
        for i, s in enumerate(own):
            start[known[s]], length[known[s]] = len(ids) + i, 1
        ids = np.append(ids, [self.special[s] for s in own]).astype(np.int32)
        # tokens of each chunk, then of each text
        of_chunk = ids[ranges(start[in_chunk], length[in_chunk])]
        edge = np.concatenate([[0], np.cumsum(length[in_chunk])])[np.concatenate([[0], np.cumsum(n_words)])]
        size = np.diff(edge)[in_text]
        flat = of_chunk[ranges(edge[:-1][in_text], size)]
        return flat, np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n_chunks)])]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        flat, edges = self.encode_flat(texts)
        ids, at = flat.tolist(), edges.tolist()
        return [ids[a:b] for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by spaces; special tokens are kept."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>: one row per document. A text is encoded whole."""

    def run(batches):
        bpe = load(path)
        for b in slices_of(batches, SLICE):
            ids = bpe.encode_batch([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids count as none."""

    def run(batches):
        bpe = load(path)
        for b in batches:
            texts = [bpe.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
IDS = ("ids", pa.list_(pa.int32()), "array<int>")


def round_trip_digest(docs: DataFrame, path: str, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: encoding and decoding in one pass over the rows, so
    that ids, which are as large as the texts, are never shuffled. with_ids adds them; keep names columns to carry along."""
    fields = DIGEST + [IDS] * with_ids

    def run(batches):
        bpe = load(path)
        for b in slices_of(batches, SLICE):
            flat, edges = bpe.encode_flat([t or "" for t in b.column("text").to_pylist()])
            at = edges.tolist()
            digest = lambda said, at=at: [hashlib.sha256(" ".join(said[x:y]).encode()).hexdigest() for x, y in zip(at, at[1:], strict=False)]
            n, coded, decoded = np.diff(edges), digest(bpe.as_number[flat].tolist()), digest(bpe.as_token[flat].tolist())
            cols = [b.column("doc_id").cast(pa.int64()), *(b.column(c) for c in keep), *(pa.array(c, f[1]) for c, f in zip((n, coded, decoded), DIGEST, strict=True))]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *keep, *(f[0] for f in fields)])
    kinds = ["doc_id long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{f[0]} {f[2]}" for f in fields)]
    return docs.select("doc_id", "text", *keep).mapInArrow(run, ", ".join(kinds))
