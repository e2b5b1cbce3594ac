"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A word's encoding is found without running merges.  An automaton over the vocabulary lists the
tokens that end at each place of the word.  For every prefix exactly one of them is the last
token of the prefix's encoding: the one that can follow the last token of the prefix before it
without a merge across their border.  Following these tokens back from the end gives the ids.
Time is linear in the word's length, also for a word of a million letters.

A pair ``a, b`` is compatible when no merge would cross the border.  While ``a`` and ``b`` are
built, their facing edges pass through the right parts of ``a`` and the left parts of ``b``;
each edge piece lives from its own merge to the merge that swallows it.  A crossing merge
happens if two facing pieces have a merge of lower rank than the ones that swallow them; at
equal rank the left place goes first.

Texts come in Arrow batches.  A batch is cut at blanks into pieces and these into words, of which
each distinct one is encoded once.  numpy takes all words of a batch through the automaton
together, prefix by prefix; moves and pairs that were worked out before are looked up in hash
tables of fixed size.  The ids of pieces and texts are gathered from those of the words.

The vocabulary file (``public_tokenizers``, ``word_bpe_49k.json``) is a parameter.  Unicode
normalisation and the split into words follow that file through the tokenizers library; pieces
of plain letters need no more than lower case and are cut by the classes of their bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from logweave.llm.common import map_rows

#: Stands for the end of a word inside the automaton; no word holds it.
END = 10
SUFFIX = "</w>"
NEVER = 1 << 30

#: Slots of a worker's tables of moves and of pairs, as a power of two; half of them are used.
TABLE_BITS = 20
#: Pieces whose ids are gathered at a time.
GATHERED = 1 << 20
#: Bytes of the longest words that go through the automaton together; longer ones go alone.
TOGETHER = 64
#: Pieces of these letters need no normalisation but lower case; all but ASCII ones are letters.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
LETTER, DIGIT, SIGN = range(3)
CLASSES = np.array([LETTER if b >= 128 or chr(b) in "abcdefghijklmnopqrstuvwxyz" else DIGIT if chr(b) in "0123456789" else SIGN
                    for b in range(256)], np.uint8)
#: What an apostrophe at a word's beginning makes a word with.
SHORT, LONG = b"stmd", (b"re", b"ve", b"ll")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: visible Latin-1 letters for themselves, the rest from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Table:
    """Values of whole-number keys, made on first use and remembered in a hash table of fixed size."""

    def __init__(self, make: Callable[[int], int], bits: int = TABLE_BITS):
        self.make, self.bits, self.mask = make, bits, (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.used = 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys, and the places of those that are not there."""
        slots = self.slots(keys)
        there = self.keys[slots]
        values = self.values[slots]
        absent = []
        open_ = np.flatnonzero(there != keys)
        while len(open_):
            free = there[open_] < 0
            absent.append(open_[free])
            open_ = open_[~free]
            slots[open_] = (slots[open_] + 1) & self.mask
            there[open_] = self.keys[slots[open_]]
            values[open_] = self.values[slots[open_]]
            open_ = open_[there[open_] != keys[open_]]
        return values, np.concatenate(absent) if absent else np.empty(0, np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        values, absent = self.find(keys)
        if len(absent):
            new, place = np.unique(keys[absent], return_inverse=True)
            made = np.fromiter(map(self.make, new.tolist()), np.int32, len(new))
            values[absent] = made[place]
            if self.used + len(new) > len(self.keys) // 2:
                self.clear()
            for key, slot, value in zip(new[: len(self.keys) // 2].tolist(), self.slots(new).tolist(), made.tolist()):
                while self.keys[slot] >= 0:
                    slot = (slot + 1) & self.mask
                self.keys[slot], self.values[slot] = key, value
                self.used += 1
        return values


class Automaton:
    """Lists the entries of a vocabulary that end at each place of a word, longest first.

    States are the beginnings of entries; a state's link is its longest ending that is a state, and
    ``entry`` is the first state along its links, itself included, that is a whole entry.
    """

    def __init__(self, entries: Iterable[tuple[bytes, int]]):
        self.moves: list[dict[int, int]] = [{}]
        token, depth = [-1], [0]
        for text, number in entries:
            state = 0
            for letter in text:
                after = self.moves[state].get(letter)
                if after is None:
                    after = self.moves[state][letter] = len(self.moves)
                    self.moves.append({})
                    token.append(-1)
                    depth.append(depth[state] + 1)
                state = after
            token[state] = number
        self.links = [0] * len(self.moves)
        entry = [0] * len(self.moves)
        reached = list(self.moves[0].values())
        for state in reached:
            entry[state] = state if token[state] >= 0 else entry[self.links[state]]
            for letter, after in self.moves[state].items():
                self.links[after] = self.move(self.links[state], letter)
                reached.append(after)
        self.token, self.depth, self.link, self.entry = (np.array(x, np.int32) for x in (token, depth, self.links, entry))
        self.table = Table(lambda key: self.move(key >> 8, key & 255))

    def move(self, state: int, letter: int) -> int:
        while state and letter not in self.moves[state]:
            state = self.links[state]
        return self.moves[state].get(letter, 0)


def gather(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values one after the other, and where each ends; run n begins at ``begins[n]``."""
    own = sizes[index]
    ends = np.cumsum(own)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[index] - (ends - own), own)], ends


def run_begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class Encoder:
    """Encodes and decodes whole texts exactly as the vocabulary's own library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.library = Tokenizer.from_file(path)
        end = chr(END)
        vocab = {t.removesuffix(SUFFIX) + end if t.endswith(SUFFIX) and t != SUFFIX else t: i
                 for t, i in model["model"]["vocab"].items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[int, int] = {}
        self.rank = [-1] * len(vocab)
        self.left, self.right = [-1] * len(vocab), [-1] * len(vocab)
        for rank, (left, right) in enumerate(model["model"]["merges"]):
            a, b = (t.removesuffix(SUFFIX) + end if t.endswith(SUFFIX) else t for t in (left, right))
            made = vocab[a + b]
            self.merges.setdefault(vocab[a] << 17 | vocab[b], rank)
            if made not in self.parts:
                self.parts[made] = self.left[made], self.right[made] = vocab[a], vocab[b]
                self.rank[made] = rank
        self.bytes_of = {ord(letter): byte for byte, letter in byte_letters().items()}
        self.automaton = Automaton(
            (self.as_bytes(text), token)
            for text, token in vocab.items()
            if self.spells(text) and (token not in self.parts or self.compatible_inside(token))
        )
        self.pairs = Table(lambda key: self.compatible(key >> 17, key & 0x1FFFF))
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special_pieces = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.names = [b""] * size
        for text, token in [*model["model"]["vocab"].items(), *self.special.items()]:
            self.names[token] = text.encode()

    def spells(self, text: str) -> bool:
        """Whether a vocabulary entry stands for bytes of a word; the others are special."""
        return all(ord(letter) in self.bytes_of for letter in text.removesuffix(chr(END)))

    def as_bytes(self, text: str) -> bytes:
        """Bytes that letters of the vocabulary stand for."""
        return bytes(self.bytes_of.get(ord(letter), END) for letter in text)

    def compatible_inside(self, token: int) -> bool:
        """Whether a merged token is what its own text encodes to."""
        left, right = self.parts[token]
        return (
            all(p not in self.parts or self.compatible_inside(p) for p in (left, right))
            and self.compatible(left, right, self.rank[token])
        )

    def compatible(self, a: int, b: int, below: int = NEVER) -> bool:
        """Whether no merge of a rank below ``below`` crosses the border of ``a`` and ``b``.

        The walk undoes the later of the two facing merges first, so it meets just the pieces
        that face each other at some time.
        """
        rank, merges, a_ends, b_ends = self.rank, self.merges, below, below
        while True:
            crossing = merges.get(a << 17 | b, NEVER)
            if crossing < a_ends and (crossing <= b_ends if b_ends < below else crossing < b_ends):
                return False
            if rank[a] > rank[b]:
                a_ends, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                b_ends, b = rank[b], self.left[b]
            else:
                return True

    def encode_words(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        alone = int(np.count_nonzero(lengths > TOGETHER))
        parts = [self.encode_together(data, offsets[[n]], lengths[[n]]) for n in order[:alone]]
        rest = order[alone:]
        parts.append(self.encode_together(data, offsets[rest], lengths[rest]))
        ids, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        found, _ = gather(ids, run_begins(sizes), sizes, place)
        return found, sizes[place]

    def encode_together(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode_words`` of words in descending order of length, prefix by prefix."""
        if len(lengths) == 1 and lengths[0] > TOGETHER:
            return self.encode_alone(data[begins[0] : begins[0] + lengths[0]].tolist())
        automaton, count = self.automaton, len(lengths)
        deepest = int(lengths[0]) + 1 if count else 0
        last, start = np.zeros((deepest + 1, count), np.int32), np.zeros((deepest + 1, count), np.int32)
        states = np.zeros(count, np.int64)
        active = count
        for end in range(1, deepest + 1):
            active = int(np.searchsorted(-lengths, 1 - end, "right"))
            place = np.minimum(begins[:active] + end - 1, len(data) - 1)
            letters = np.where(lengths[:active] < end, END, data[place] if len(data) else END)
            states = automaton.table.get(states[:active].astype(np.int64) << 8 | letters)
            words, at = np.arange(active), automaton.entry[states]
            while len(words):
                token, begin = automaton.token[at].astype(np.int64), end - automaton.depth[at]
                fits = begin == 0
                inside = np.flatnonzero(~fits)
                before = last[begin[inside], words[inside]].astype(np.int64)
                fits[inside] = self.pairs.get(before << 17 | token[inside]) != 0
                last[end, words[fits]], start[end, words[fits]] = token[fits], begin[fits]
                words, at = words[~fits], automaton.entry[automaton.link[at[~fits]]]
        words, place, steps = np.arange(count), lengths + 1, []
        sizes = np.zeros(count, np.int64)
        while len(words):
            steps.append((words, last[place, words]))
            sizes[words] += 1
            place = start[place, words]
            words, place = words[place > 0], place[place > 0]
        ids, ends = np.empty(sizes.sum(), np.uint32), np.cumsum(sizes)
        for step, (words, tokens) in enumerate(steps, 1):
            ids[ends[words] - step] = tokens
        return ids, sizes

    def encode_alone(self, word: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """``encode_words`` of one long word."""
        automaton, fits = self.automaton, {}
        token, depth, link, entry = (x.tolist() for x in (automaton.token, automaton.depth, automaton.link, automaton.entry))
        last, start, state = [0], [0], 0
        for end, letter in enumerate([*word, END], 1):
            state = automaton.move(state, letter)
            at = entry[state]
            while end > depth[at]:
                pair = last[end - depth[at]] << 17 | token[at]
                if pair not in fits:
                    fits[pair] = self.compatible(pair >> 17, pair & 0x1FFFF)
                if fits[pair]:
                    break
                at = entry[link[at]]
            last.append(token[at])
            start.append(end - depth[at])
        ids, place = [], len(word) + 1
        while place:
            ids.append(last[place])
            place = start[place]
        return np.array(ids[::-1], np.uint32), np.array([len(ids)])

    def encode_plain(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of plain letters, one after the other, and how many each has.

        Words are runs of letters, single digits, runs of other signs, and an apostrophe that begins
        a word with the ending behind it.
        """
        if not len(pieces):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lower = pc.utf8_lower(pieces)
        offsets = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
        data = np.frombuffer(lower.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kinds = CLASSES[data]
        first = np.zeros(len(data) + 3, bool)
        first[offsets] = True
        begins = first.copy()
        begins[1 : len(data)] |= (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
        marks = np.flatnonzero(data == ord("'"))
        marks = marks[begins[marks] & ~first[marks + 1]]
        after = np.concatenate([data, np.zeros(3, np.uint8)])
        short = marks[np.isin(after[marks + 1], list(SHORT))]
        pairs = after[marks + 1].astype(int) << 8 | after[marks + 2]
        long = marks[np.isin(pairs, [a << 8 | b for a, b in LONG]) & ~first[marks + 2]]
        for found, size in ((short, 2), (long, 3)):
            begins[found + 1] = False
            begins[found + size] = True
        places = np.append(np.flatnonzero(begins[: len(data)]), len(data))
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)]
        ).dictionary_encode()
        ids, sizes = self.encode_words(words.dictionary)
        found, ends = gather(ids, run_begins(sizes), sizes, words.indices.to_numpy())
        return found, np.diff(np.append(0, ends)[np.searchsorted(places, offsets)])

    def words_of(self, text: str) -> list[bytes]:
        """Words of a text without special tokens."""
        normal = self.library.normalizer.normalize_str(text)
        return [self.as_bytes(word) for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_other(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces with any letters and with special tokens."""
        parts = []
        for piece in pieces:
            own = []
            for part in self.special_pieces.split(piece):
                own += [part] if part in self.special else self.words_of(part) if part else []
            parts.append(own)
        words = sorted({word for own in parts for word in own if isinstance(word, bytes)})
        flat, sizes = self.encode_words(pa.array(words, pa.large_binary()))
        runs = np.split(flat, np.cumsum(sizes)[:-1]) if words else []
        ids_of = {word: run.tolist() for word, run in zip(words, runs)} | {text: [token] for text, token in self.special.items()}
        ids = [[i for word in own for i in ids_of[word]] for own in parts]
        return np.array([i for own in ids for i in own], np.uint32), np.array([len(own) for own in ids], np.int64)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids (32-bit little-endian) of whole texts; null counts as the empty text.

        Pieces between ASCII blanks are encoded on their own: neither normalisation nor words
        nor special tokens reach across a blank.
        """
        split = pc.ascii_split_whitespace(pa.array([text or "" for text in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary
        plain = pc.match_substring_regex(pieces, PLAIN)
        for mark in self.special:
            plain = pc.and_not(plain, pc.match_substring(pieces, mark))
        plain_ids, plain_sizes = self.encode_plain(pieces.filter(plain))
        other_ids, other_sizes = self.encode_other(pieces.filter(pc.invert(plain)).to_pylist())
        ids = np.concatenate([plain_ids, other_ids])
        plain = plain.to_numpy(zero_copy_only=False)
        sizes, begins = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        sizes[plain], sizes[~plain] = plain_sizes, other_sizes
        begins[plain], begins[~plain] = run_begins(plain_sizes), len(plain_ids) + run_begins(other_sizes)
        return self.texts_of(ids, begins, sizes, coded.indices.to_numpy(), split.offsets.to_pylist())

    def texts_of(self, ids, begins, sizes, index, bounds) -> list[bytes]:
        """Ids of each text, from those of its pieces, some pieces at a time."""
        out, held, at = [], [], 0
        for begin in range(0, max(1, len(index)), GATHERED):
            part = index[begin : begin + GATHERED]
            found, ends = gather(ids, begins, sizes, part)
            found, ends, done = found.tobytes(), np.append(0, ends), 0
            while at + 1 < len(bounds) and bounds[at + 1] <= begin + len(part):
                end = 4 * int(ends[bounds[at + 1] - begin])
                out.append(b"".join([*held, found[done:end]]))
                held, done, at = [], end, at + 1
            held.append(found[done:])
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids (32-bit little-endian) of one text."""
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids, special tokens included: the vocabulary's entries, blank-separated."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and
    decoded_sha256 (of the decoded text in UTF-8), one row per row of ``documents``.  A null
    text is empty: no ids.  Repeated rows stay, a null doc_id stays null, other columns are
    not read; an empty table gives an empty result.
    """
    path = path or vocabulary_path()

    def work(texts, state):
        rows = []
        for ids in state.encode_batch(texts):
            decoded = state.decode(ids)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return rows

    return map_rows(documents, ["text"], work, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                    keep=("doc_id",), setup=lambda: encoder(path))
