"""BPE encoding by a trie of words: encodings of shared prefixes are made once; and decoding."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from procgraph.llm.common import doc_text
from procgraph.llm.token_ids import WordEncoder, WordMemory, text_batches, texts_of, vocabulary_path, words_in

#: Symbols up to which a piece goes into the trie; a longer one shares no prefix worth a node a symbol and is walked alone.
LONGEST_IN_TRIE = 64
#: Bytes of text whose new words are one trie, words and pairs of tokens that a task remembers: some 130 MB together.
TRIE_BYTES = 2 << 20
MOST_WORDS = 400_000
MOST_CHECKED = 200_000
#: Tokens that are decoded at once, about.
DECODED = 1 << 20


class Merges:
    """Tokens of a BPE vocabulary with an end-of-word suffix, and which may follow each other.

    The encoding of a piece is known from the last token of each of its prefixes (its state): the
    encoding of the prefix without that token comes before. Of the tokens that a prefix ends with, the last one is
    the one that fits what is before it: merging both strings together leaves the border between them.
    """

    def __init__(self, path: str):
        with open(path) as f:
            whole = json.load(f)
        model = whole["model"]
        suffix, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        if model["continuing_subword_prefix"] or model["ignore_merges"] or model["dropout"] or not suffix:
            raise ValueError("not a plain BPE vocabulary with an end-of-word suffix")
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.rank, self.parts, self.pairs, self.checked = {}, {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            if made in self.rank or max(self.rank.get(left, -1), self.rank.get(right, -1)) >= rank:
                raise ValueError(f"{a} + {b} has several merges, or one before those of its parts")
            self.rank[made], self.parts[made], self.pairs[left << 20 | right] = rank, (left, right), rank
        whole_tokens = {t for t in vocab.values() if t not in self.parts}
        for made, (left, right) in self.parts.items():  # parts come before what they make
            if left in whole_tokens and right in whole_tokens and self._border(left, right, self.rank[made]):
                whole_tokens.add(made)
        tokens = [(s, t) for s, t in vocab.items() if t in whole_tokens]
        self.ending = {s[: -len(suffix)]: t for s, t in tokens if s.endswith(suffix)}
        self.inner = {s: t for s, t in tokens if not s.endswith(suffix)}
        self.inner_reach, self.ending_reach = self._reach(self.inner), self._reach(self.ending)
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in whole["added_tokens"]):
            raise ValueError("added tokens must be plain strings")

    def _border(self, left: int, right: int, until: float) -> bool:
        """Whether the border between two tokens stays while merges of a rank below `until` are made.

        Their merges are undone from the last to the first. Two tokens stand at the border until
        the merge that was just undone; their own merge, if it is earlier, would have closed it. Of
        equal ranks the left place is merged first.
        """
        rank, none, tied = self.rank, -1, False
        while True:
            own = self.pairs.get(left << 20 | right)
            if own is not None and (own < until or own == until and tied):
                return False
            a, b = rank.get(left, none), rank.get(right, none)
            if a == b == none:
                return True
            if a > b:
                until, left, tied = a, self.parts[left][1], False
            else:
                until, right, tied = b, self.parts[right][0], True

    def fits(self, left: int, right: int) -> bool:
        key = left << 16 | right
        known = self.checked.get(key)
        if known is None:
            if len(self.checked) > MOST_CHECKED:
                self.checked.clear()
            known = self.checked[key] = self._border(left, right, float("inf"))
        return known

    @staticmethod
    def _reach(tokens: dict[str, int]) -> dict[str, int]:
        """The longest token with each ending of three symbols, so that no longer one is tried."""
        out: dict[str, int] = {}
        for token in tokens:
            out[token[-3:]] = max(len(token), out.get(token[-3:], 2))
        return out

    def states(self, piece: str, start: int, end: int, last: list[int], before: list[int]) -> None:
        """Sets the states of the prefixes of start to end symbols: last token and depth before it; those of shorter ones are set."""
        get, reach, checked = self.inner.get, self.inner_reach.get, self.checked.get
        for depth in range(start, end + 1):
            length = reach(piece[max(0, depth - 3) : depth], 2)
            if length > depth:
                length = depth
            while True:
                if (token := get(piece[depth - length : depth])) is not None:
                    at = depth - length
                    if at == 0 or (fits := checked(last[at] << 16 | token)) or fits is None and self.fits(last[at], token):
                        break
                length -= 1
            last[depth], before[depth] = token, at

    def ids(self, piece: str, last: list[int], before: list[int]) -> bytes:
        """Ids of a piece from the states of its prefixes: the token that fits and ends the word, then back from state to state."""
        size = len(piece)
        length = min(size, self.ending_reach.get(piece[-3:], 2))
        while (token := self.ending.get(piece[size - length :])) is None or length < size and not self.fits(last[size - length], token):
            length -= 1
        ids, depth = [token], size - length
        while depth:
            ids.append(last[depth])
            depth = before[depth]
        ids.reverse()
        return array("I", ids).tobytes()

    def walk(self, piece: str) -> bytes:
        """Ids of a piece along its own path."""
        last, before = [0] * len(piece), [0] * len(piece)
        self.states(piece, 1, len(piece) - 1, last, before)
        return self.ids(piece, last, before)

    def encode(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of each piece: a depth-first walk over the trie of them all sets the state of every shared prefix once.

        A node maps symbols to nodes, or to a piece where no other has the same prefix; "" is the piece that ends there.
        """
        found, root = {}, {}
        for piece in pieces:
            if len(piece) > LONGEST_IN_TRIE:
                found[piece] = self.walk(piece)
                continue
            node = root
            for depth, symbol in enumerate(piece, 1):
                below = node.get(symbol)
                if below is None:
                    node[symbol] = piece
                    break
                if below.__class__ is str:  # a piece alone so far: it moves one down
                    node[symbol] = {below[depth : depth + 1]: below}
                    below = node[symbol]
                node = below
            else:
                node[""] = piece
        last, before, fits = [0] * (LONGEST_IN_TRIE + 1), [0] * (LONGEST_IN_TRIE + 1), self.fits
        get, reach, checked = self.inner.get, self.inner_reach.get, self.checked.get
        stack = [(1, symbol, node) for symbol, node in root.items()]
        while stack:
            depth, prefix, node = stack.pop()
            if node.__class__ is str:
                if len(node) > depth:
                    self.states(node, depth, len(node) - 1, last, before)
                found[node] = self.ids(node, last, before)
                continue
            if (piece := node.pop("", None)) is not None:
                found[piece] = self.ids(piece, last, before)
                if not node:
                    continue
            length = reach(prefix[-3:], 2)  # as in states, without a call for each node
            at = depth - length if length < depth else 0
            while (token := get(prefix[at:])) is None or at and not ((ok := checked(last[at] << 16 | token)) or ok is None and fits(last[at], token)):
                at += 1
            last[depth], before[depth] = token, at
            depth += 1
            stack += [(depth, prefix + symbol, below) for symbol, below in node.items()]
        return found


@lru_cache(maxsize=2)
def names_of(path: str) -> list[str]:
    """The string of each id, special tokens included; "" where there is none."""
    with open(path) as f:
        whole = json.load(f)
    names = {t: s for s, t in whole["model"]["vocab"].items()} | {x["id"]: x["content"] for x in whole["added_tokens"]}
    return [names.get(i, "") for i in range(max(names) + 1)]


class TrieEncoder(WordEncoder):
    """Ids of whole texts as WordEncoder has them, the words not known yet through a trie.

    Normal forms, lower case and the cut of words into pieces are the library's; its merges aren't used.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        super().__init__(path)
        self.memory = WordMemory(self._encode, most)
        self.merges = Merges(path)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")") if self.merges.special else None

    def _pieces(self, word: str) -> list[str]:
        """The byte-level pieces of a word without special tokens."""
        head = word.rstrip(".,;:!?")
        if head.isascii() and head.isalpha():
            return [head.lower(), word[len(head) :]] if len(head) < len(word) else [head.lower()]
        if head.isalpha() and max(head) <= "\u1fff" and "\u03a3" not in head and is_normalized("NFC", head):
            small = head.lower()
            if small.isalpha() and max(small) <= "\u1fff":
                tail = word[len(head) :]
                small = small if small.isascii() else small.translate(self.letters)
                return [small, tail] if tail else [small]
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word))]

    def _encode(self, words: list) -> list:
        special, made, ids, new, known = self.merges.special, [], {}, set(), self.memory.known
        for word in words:
            if self.specials and "<" in word and (cut := self.specials.split(word))[1:]:
                pieces = []
                for i, part in enumerate(cut):
                    if i % 2:
                        ids[part] = array("I", [special[part]]).tobytes()  # a piece never has < and letters
                        pieces.append(part)
                    elif part:
                        pieces += self._pieces(part)
            else:
                pieces = self._pieces(word)
            made.append(pieces)
            for x in pieces:
                if x not in ids and x not in new:
                    if x.isascii() and x in known and x.isalpha() and x.islower():  # remembered as a word
                        ids[x] = known[x]
                    else:
                        new.add(x)
        ids |= self.merges.encode(new)
        return [ids[p[0]] if len(p) == 1 else b"".join([ids[x] for x in p]) for p in made]


    def __call__(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        codes, offsets, words = words_in(texts)
        parts = self.memory(words.to_pylist())
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])
        return b"".join([parts[c] for c in codes.tolist()]), ends[offsets]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> TrieEncoder:
    """One encoder a worker process: what it remembers serves its next tasks too."""
    return TrieEncoder(path)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): every whole text's ids, little-endian unsigned 32-bit, as the tokenizers library gives them without its special tokens added.

    A null text has no ids, as an empty one. Each row of docs gives one, with its doc_id (null or repeated
    ones too); an empty table gives none and other columns aren't read. A special token's string in a text is that token.
    """
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for table in text_batches(batches, TRIE_BYTES):
            data, ends = encoder(texts_of(table))
            offsets = pa.py_buffer((4 * ends).astype(np.int64).tobytes())
            ids = pa.Array.from_buffers(pa.large_binary(), len(table), [None, offsets, pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(np.diff(ends)), ids], names=["doc_id", "n_tokens", "ids"])

    return doc_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with `text`: the text of the ids, special tokens included. This vocabulary has no decoder, so its tokens stand between blanks."""
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = names_of(vocabulary).__getitem__
        for whole in batches:
            done = np.cumsum(whole["n_tokens"].to_numpy())
            start = 0
            while start < len(whole):
                end = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + DECODED, "right")))
                batch, start = whole.slice(start, end - start), end
                texts = [" ".join(map(name, np.frombuffer(x.as_buffer(), "<u4").tolist())) for x in batch["ids"]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")
