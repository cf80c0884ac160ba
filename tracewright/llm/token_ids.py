"""Token ids as the tokenizers library gives them, each different word of a batch encoded once.

A tokenizer that drops white space and never merges across it gives a text the ids of its
white-space-separated words in order. Texts are split by Arrow and the words of a batch made
distinct. Words of ASCII and Latin-1 letters are normalised, split and merged here, all words at
once; other words go to the library, and the ids are gathered by numpy. Other tokenizers encode
whole texts. Nothing is kept from batch to batch but the vocabulary.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged, text_bytes, worker_state
from .pair_merges import LONGEST, PairTable


def splits_at_blanks(spec: dict) -> bool:
    """Whether the tokenizer file (parsed JSON) drops white space between words that it never joins."""
    steps = lambda x: (x.get("normalizers") or x.get("pretokenizers") or [x]) if x else []
    normal = {"NFC", "NFD", "Lowercase", "StripAccents"}
    for s in steps(spec.get("normalizer")):
        if s["type"] == "Replace" and s["pattern"].get("Regex") == r"\s+" and s["content"] == " ":
            continue
        if s["type"] not in normal:
            return False
    first = (steps(spec.get("pre_tokenizer")) or [{"type": None}])[0]
    if any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens") or []):
        return False
    if first["type"] in ("WhitespaceSplit", "BertPreTokenizer", "Whitespace"):
        return True
    # Known form: keep only matches of alternatives none of which can match white space.
    return first["type"] == "Split" and first.get("invert") is True and first.get("behavior") == "Removed" and first["pattern"].get("Regex") == BLANK_FREE


#: Fixed value: the pre-tokenizer pattern of the word-end BPE file; no alternative matches white space.
BLANK_FREE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Bytes of plain words: visible ASCII but the apostrophe, and the UTF-8 of Latin-1 letters (0xC3 and a second byte).
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0x27] = False
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False  # multiplication and division sign
#: Lower case of a byte behind 0xC3 (row 1) and of any other byte (row 0).
_LOWER = np.tile(np.arange(256, dtype=np.uint8), (2, 1))
_LOWER[0, 0x41:0x5B] += 32
_LOWER[1, 0x80:0x9F] += 32
#: Kinds of lower-cased bytes: letter, digit, other.
_KIND = np.full(256, 2, np.int8)
_KIND[0x61:0x7B] = 0
_KIND[0x80:] = 0
_KIND[0x30:0x3A] = 1


def has_plain_words(spec: dict) -> bool:
    """Whether a plain word's ids are those of its lower-cased pieces under the model's merges alone."""
    normal = (spec.get("normalizer") or {}).get("normalizers") or []
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = spec["model"]
    return (
        [s["type"] for s in normal] == ["NFC", "Replace", "Lowercase"]
        and [s["type"] for s in pre] == ["Split", "ByteLevel"]
        and pre[0]["pattern"].get("Regex") == BLANK_FREE
        and not pre[1]["add_prefix_space"]
        and not pre[1]["use_regex"]
        and all(t["content"].startswith("<|") for t in spec.get("added_tokens") or [])
        and model["type"] == "BPE"
        and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    )


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [letter[b] for b in range(256)]


class PlainWords:
    """Ids of plain words by the vocabulary's merges, for all words of a batch at once."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        at = lambda f: np.fromiter(map(f, merges), np.int64, len(merges))
        self.table = PairTable(at(lambda m: vocab[m[0]]), at(lambda m: vocab[m[1]]), np.arange(len(merges)), at(lambda m: vocab[m[0] + m[1]]), max(vocab.values()) + 1)

    @staticmethod
    def plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which words are plain; ``<|`` may open a control token."""
        before = np.concatenate([np.zeros(1, np.uint8), data[:-1]])
        after = np.concatenate([data[1:], np.zeros(1, np.uint8)])
        good = np.where(data == 0xC3, _SECOND[after], np.where(before == 0xC3, _SECOND[data], _VISIBLE[data])) & ~((before == 0x3C) & (data == 0x7C))
        wrong = np.concatenate([[0], np.cumsum(~good)])
        return wrong[offsets[1:]] == wrong[offsets[:-1]]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words one after another, how many each has, and which words are told.

        Words that are not plain or have a piece of more than ``LONGEST`` bytes have no ids.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64), offsets[1:] > offsets[:-1]
        told = self.plain(data, offsets)
        follows = np.concatenate([[0], (data[:-1] == 0xC3).astype(np.int8)])
        low = _LOWER[follows, data]
        kind = _KIND[low]
        begin = np.zeros(n + 1, bool)
        begin[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        begin[offsets] = True
        starts = np.flatnonzero(begin[:n])
        lengths = np.diff(np.concatenate([starts, [n]]))
        symbols = self.inner[low]
        ends = starts + lengths - 1
        symbols[ends] = self.last[low[ends]]
        word = np.searchsorted(offsets, starts, side="right") - 1
        told[word[lengths > LONGEST]] = False
        taken = told[word]
        if not taken.all():
            symbols, starts, lengths, word = symbols[np.repeat(taken, lengths)], starts[taken], lengths[taken], word[taken]
        ids, each = self.table.merge(symbols, lengths)
        counts = np.bincount(word, each, minlength=len(offsets) - 1).astype(np.int64)
        return ids, counts, told


class WordEncoder:
    """Ids of whole texts; one object a worker and tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = splits_at_blanks(spec)
        self.words = PlainWords(spec["model"]) if self.by_word and has_plain_words(spec) else None
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _library(self, words: list[str]) -> list[list[int]]:
        # One call for many words: the library tells for each id which word it came from.
        out: list[list[int]] = [[] for _ in words]
        if words:
            e = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            for of, x in zip(e.word_ids, e.ids, strict=True):
                out[of].append(x)
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of different words, one word after another, and how many each has."""
        words = words.cast(pa.large_string())
        if self.words:
            ids, counts, told = self.words.encode(*text_bytes(words))
        else:
            ids, counts, told = np.zeros(0, np.int32), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        if not told.all():
            rest = np.flatnonzero(~told)
            each = self._library(words.take(pa.array(rest)).to_pylist())
            at = np.repeat((np.cumsum(counts) - counts)[rest], [len(x) for x in each])
            ids = np.insert(ids, at, [i for x in each for i in x])
            counts[rest] = [len(x) for x in each]
        return ids, counts

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one text after another, and how many each text has. A null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_word:
            each = [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            counts = np.array([len(x) for x in each], np.int64)
            ids = np.concatenate([*each, np.zeros(0, np.uint32)])
        else:
            split = pc.ascii_split_whitespace(texts)
            coded = split.flatten().dictionary_encode()
            known, n = self._words(coded.dictionary)
            of = coded.indices.to_numpy(zero_copy_only=False)
            lengths = n[of]
            ids = ragged(known.astype(np.uint32), (np.cumsum(n) - n)[of], lengths)
            ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
            upto = np.concatenate([[0], np.cumsum(lengths)])[ends]
            counts = np.diff(upto, prepend=0).astype(np.int64)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(counts), end_id) if len(counts) else ids
            counts = counts + 1
        return ids.astype(np.uint32, copy=False), counts


def encoder(path: str) -> WordEncoder:
    return worker_state(("word-encoder", path), lambda: WordEncoder(path))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
