"""Words and token ids of whole Arrow batches: distinct words are looked up once a batch."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.Table]:
    """The batches in slices of about most_bytes of text (a longer text stands alone); null texts stay null."""
    for batch in batches:
        table = pa.table(batch.columns, batch.schema.names)
        at = table.schema.get_field_index("text")
        table = table.set_column(at, "text", table["text"].cast(pa.large_string()))
        size = np.cumsum(pc.binary_length(table["text"]).fill_null(0).to_numpy())
        start = 0
        while start < len(table):
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + most_bytes, "right")))
            yield table.slice(start, end - start)
            start = end


def release_unused() -> None:
    """Gives memory that a task has freed back to the system: workers are used again, and an idle one would hold it beside the next stage."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def texts_of(table: pa.Table) -> pa.Array:
    return pc.fill_null(table["text"].combine_chunks(), "")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` as (code of each word, first word of each text and the end, the distinct words)."""
    lists = pc.ascii_split_whitespace(texts)
    values, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(values), 0)
    if not pc.all(full).as_py() and len(values):
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        values, offsets = values.filter(full), before[offsets]
    coded = values.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), offsets, coded.dictionary


def strings(words: pa.Array) -> list:
    """The strings of an array without nulls; by numpy that takes a tenth of to_pylist's time."""
    return words.to_numpy(zero_copy_only=False).tolist()


class WordMemory:
    """Values of words by a function of a list of words, remembered for a bounded number of short ones."""

    def __init__(self, of_words, most: int):
        self.of_words, self.most, self.known = of_words, most, {}

    def __call__(self, words: list) -> list:
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        out = list(map(known.get, words))
        missing = [i for i, v in enumerate(out) if v is None]
        if missing:
            fresh = [words[i] for i in missing]
            for i, w, v in zip(missing, fresh, self.of_words(fresh)):
                out[i] = v
                if len(w) <= 64:
                    known[w] = v
        return out


def hash_words(words: list) -> list:
    import xxhash

    return list(map(xxhash.xxh3_64_intdigest, words))


#: Pieces that the vocabulary's pattern makes of a small ASCII word.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
#: Marks behind a word that are taken apart from it, and how many bytes of them.
MARKS, MOST_MARKS = ".,;:!?", 8


class WordEncoder:
    """Ids of whole texts by a vocabulary of the `tokenizers` library that drops white space.

    Words never meet in such a vocabulary, so each distinct word of a batch is
    encoded once, and its marks apart from what is before them. At most `most` short heads and pieces are
    remembered: memory is bounded and the ids don't depend on it. Words of letters, and the pieces of other printable ASCII words, go straight to the
    library's model; all others through its whole chain. A special token's string in a
    text is that token, as the library has it, unless plain_specials says that it is ordinary text.
    """

    def __init__(self, path: str, most: int = 300_000, plain_specials: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.model, self.most, self.known, self.pieces = self.tokenizer.model, most, {}, {}  # words of letters; pieces and marks
        as_text = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {i: as_text(chr(i))[0][0] for i in range(0x21, 0x2000) if chr(i).isalpha()}
        pattern = json.loads(self.tokenizer.pre_tokenizer.__getstate__())["pretokenizers"][0]["pattern"]["Regex"]
        self.in_pieces = pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def _plain(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _remember(self, piece: str) -> bytes:
        made = self.pieces.get(piece)
        if made is None:
            made = self._plain(piece)
            if len(piece) <= 64:
                self.pieces[piece] = made
        return made

    def _head(self, head: str) -> bytes | None:
        """Ids of a word of letters, its ASCII ones small already; None if the whole chain has to see it."""
        if not head.isalpha():
            return None
        if head.isascii():
            return self._plain(head)
        if max(head) > "\u1fff" or "\u03a3" in head or not is_normalized("NFC", head):
            return None
        head = head.lower()
        if not head.isalpha() or max(head) > "\u1fff":  # a capital whose small form adds a mark or lies beyond the letters
            return None
        return self._plain(head.translate(self.letters))

    def _rest(self, words: list) -> list:
        out, chain = [b""] * len(words), []
        for i, w in enumerate(words):
            if self.in_pieces and w.isascii() and w.isprintable() and "<|" not in w:
                out[i] = b"".join(map(self._remember, PIECES(w.lower())))
            else:
                chain.append(i)
        for i, e in zip(chain, self.tokenizer.encode_batch_fast([words[i] for i in chain], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out

    def _units(self, words: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """(units of ids, the unit of each word, the unit of the marks behind it)."""
        if len(self.known) + len(self.pieces) > self.most:
            self.known.clear()
            self.pieces.clear()
        known = self.known
        heads = pc.ascii_rtrim(words, MARKS)
        behind = pc.binary_length(words).to_numpy() - pc.binary_length(heads).to_numpy()
        coded = pc.ascii_lower(heads).dictionary_encode()
        names, first = strings(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
        units = list(map(known.get, names))
        for i in [i for i, u in enumerate(units) if u is None]:
            made = units[i] = self._head(name := names[i])
            if made is not None and len(name) <= 64:
                known[name] = made
        whole = np.array([u is None for u in units], bool)[first] | (behind > MOST_MARKS)
        units = [u or b"" for u in units]
        second = np.full(len(words), len(units))
        units.append(b"")
        for n in np.unique(behind[~whole]).tolist():
            if n:
                at = np.flatnonzero((behind == n) & ~whole)
                marks = pc.binary_slice(words.take(pa.array(at)).cast(pa.large_binary()), -n).dictionary_encode()
                second[at] = len(units) + marks.indices.to_numpy()
                units += [self._remember(m.decode()) for m in marks.dictionary.to_pylist()]
        at = np.flatnonzero(whole)
        first[at] = len(units) + np.arange(len(at))
        return units + self._rest(strings(words.take(pa.array(at)))), first, second

    def __call__(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """(ids of all texts as little-endian unsigned 32-bit, first id of each text and the end)."""
        codes, offsets, words = words_in(texts)
        units, first, second = self._units(words)
        lengths = np.fromiter(map(len, units), np.int64, len(units)) >> 2
        starts, both = np.cumsum(lengths) - lengths, np.stack([first, second], axis=1).reshape(-1)
        ids = np.frombuffer(b"".join(units), "<u4")[ragged(starts[both], lengths[both])]  # of the distinct words
        lengths = lengths[first] + lengths[second]
        starts = np.cumsum(lengths) - lengths
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])
        return ids[ragged(starts[codes], lengths[codes])].tobytes(), ends[offsets]


#: Runs of white space that are too long for the pattern of tiktoken, which goes back from their end by recursion.
LONG_SPACE = re.compile("\x20?[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}")


class ByteEncoder:
    """Ids of whole texts by a byte-level vocabulary given as ranks; its texts' special strings are ordinary text."""

    def __init__(self, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)

    def count(self, word: str) -> int:
        """Tokens of a word with a blank before it. A very long run of white space is one piece but for its last one, which goes with what follows."""
        text, n, at, encode = " " + word, 0, 0, self.encoding.encode_ordinary
        for run in LONG_SPACE.finditer(text) if len(word) >= 100_000 else ():
            end = run.end() - (run.end() < len(text))
            n += len(encode(text[at : run.start()])) + len(self.encoding._encode_single_piece(text[run.start() : end]))
            at = end
        return n + len(encode(text[at:]))


#: White space that tokenizers' patterns know besides the ASCII kind; before an ASCII one it would be cut off from its run.
OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000][\x20\x09-\x0D]")
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+").findall


class UnitEncoder:
    """Ids of whole texts by a byte-level vocabulary of the `tokenizers` library.

    A text is taken in units, a run of ASCII white space with the word after it:
    no token of such a vocabulary reaches over the end of a word, so each
    distinct unit is encoded once. The first `most` short ones are remembered; the
    ids don't depend on it. Letters, with a blank before or marks behind, go straight to the library's model, all others
    through its whole chain. Special tokens as in WordEncoder.
    """

    def __init__(self, path: str, most: int = 600_000, plain_specials: bool = False):
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.model, self.most, self.known = self.tokenizer.model, most, {}
        as_text = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {i: as_text(chr(i))[0][0] for i in range(0x20, 0x2000) if chr(i).isalpha() or chr(i) == " "}

    def _encode(self, units: list) -> list:
        out, rest, plain, tails, letters = [b""] * len(units), [], self.model.tokenize, {"": b""}, self.letters
        blank = letters[0x20]
        for i, unit in enumerate(units):
            head = unit.rstrip(".,;:!?")
            bare = head[1:] if head[:1] == " " else head
            if not bare.isalpha():
                rest.append(i)
                continue
            if not bare.isascii():
                if max(bare) > "\u1fff":
                    rest.append(i)
                    continue
                bare = bare.translate(letters)
            made = array("I", [t.id for t in plain(blank + bare if head[0] == " " else bare)]).tobytes()
            if len(head) < len(unit):
                tail = unit[len(head) :]
                if tail not in tails:
                    tails[tail] = array("I", [t.id for t in plain(tail)]).tobytes()
                made += tails[tail]
            out[i] = made
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([units[i] for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out

    def __call__(self, texts: list) -> list[np.ndarray]:
        """The ids of each text; a null one has none."""
        odd = [bool(t) and not t.isascii() and OTHER_SPACE.search(t) is not None for t in texts]
        units = [[t] if x else UNITS(t or "") for t, x in zip(texts, odd)]
        new = set(chain.from_iterable(units)).difference(self.known)
        new, room = list(new), self.most - len(self.known)
        self.known.update(zip(new, self._encode(new)))
        of = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(of, u)), "<u4") for u in units]
        for i, u in enumerate(new):
            if i >= room or len(u) > 64:
                del self.known[u]
        return out
