"""Token ids by the tokenizers library, each distinct piece of a batch encoded once.

A byte-level BPE splits text into pre-tokens first and never merges across them. A cut before a space, or
before a line feed, that is followed by something else than white space always lies between pre-tokens, so
a text may be encoded piece by piece. A batch's pieces are made and counted by Arrow, its distinct ones go
to the library, and the ids of all texts are gathered by NumPy. A text with any other white space joins the
pieces around it before they are encoded. A text that holds one of the vocabulary's added tokens (such as
<|endoftext|>) goes to the library whole, where those are to be read as tokens. A
worker remembers a bounded number of words from one batch to the next.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A batch is cut to so many characters, or to one text where that is longer.
BATCH_CHARS = 2_000_000
#: Words that a worker remembers with their ids (the first it sees, so the common ones), and the longest of them.
REMEMBERED, LONGEST = 200_000, 32
MARKS = string.punctuation  # these follow letters as pre-tokens of their own
NO_MARKS = f"^[^{re.escape(MARKS)}]+"


def default_vocabulary() -> str:
    """The byte-level vocabulary of the machine's tokenizer files; any other file can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _regular(piece: str) -> bool:
    """Whether the cut before a piece, which follows a space or begins with a line feed, is between pre-tokens."""
    begins = piece[1:2] if piece[:1] == "\n" else piece[:1]
    return bool(begins) and not begins.isspace()


class Encoder:
    def __init__(self, vocabulary: str, added: bool = False):
        """added: read added tokens in texts as the library does by default, not as plain characters."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.whole.encode_special_tokens = True
        size = self.whole.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        shown = self.whole.encode(" ", add_special_tokens=False).tokens[0]  # how the vocabulary writes a space
        self.spaced = np.array([(self.whole.id_to_token(i) or "").startswith(shown) for i in range(size)])
        self.line = self.whole.encode("\n", add_special_tokens=False).ids[0]
        self.remembered = (pa.array([], pa.string()), np.zeros(0, self.kind), np.zeros(0, np.int64))  # words, their ids, how many each has
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values() if t.content] if added else []

    def _texts(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype=self.kind).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters alone, each after a space or a line feed, and how many each word has. They
        are encoded in one text, whose ids fall apart again at the tokens that begin with a space, or are the
        line feed."""
        if not words:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        ids = np.asarray(self.whole.encode_batch_fast([before + before.join(words)], add_special_tokens=False)[0].ids)
        sizes = np.diff(np.append(np.flatnonzero(self.spaced[ids] if before == " " else ids == self.line), len(ids)))
        if len(sizes) != len(words):
            raise ValueError("the vocabulary doesn't cut before every space")
        return ids.astype(self.kind), sizes

    def _known_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word, after a space, lies in a table of words, and the table: ids and how many each word has.
        It is the remembered words, then those that are not there; these are encoded, and join the remembered
        ones while there is room."""
        known, ids, sizes = self.remembered
        places = pc.index_in(words, value_set=known)
        new = places.is_null()
        fresh = words.filter(new)
        new_ids, new_sizes = self._words(fresh.to_pylist(), " ")
        at = np.array(pc.fill_null(places, 0)).astype(np.int32)
        at[np.asarray(new)] = len(known) + np.arange(len(fresh))
        room = REMEMBERED - len(known)
        if room > 0 and len(fresh):
            kept = np.asarray(pc.utf8_length(fresh)) <= LONGEST
            kept &= kept.cumsum() <= room
            self.remembered = (pa.concat_arrays([known, fresh.filter(pa.array(kept))]), np.concatenate([ids, new_ids[np.repeat(kept, new_sizes)]]), np.concatenate([sizes, new_sizes[kept]]))
        return at, np.concatenate([ids, new_ids]), np.concatenate([sizes, new_sizes])

    def _texts_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._texts(texts)
        return np.frombuffer(b"".join(found), dtype=self.kind), np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.kind).itemsize

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text as integers of self.kind; a null has none."""
        if not len(texts):
            return []
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " \n"), " ")
        ends = np.asarray(cut.offsets).astype(np.int64) - cut.offsets[0].as_py()
        flat = cut.flatten()
        coded = flat.dictionary_encode()
        pieces, codes = coded.dictionary, np.array(coded.indices)
        firsts = flat.take(pa.array(ends[:-1])).dictionary_encode()  # these follow nothing

        # a piece is a word of letters with marks after it, the same after a line feed, or something else
        bare = pc.utf8_rtrim(pieces, characters=MARKS)
        plain = np.asarray(pc.utf8_is_alpha(bare))
        words = bare.filter(pa.array(plain)).dictionary_encode()
        other = np.flatnonzero(~plain)
        others = pieces.take(pa.array(other)).to_pylist()
        regular = np.fromiter(map(_regular, others), bool, len(others))
        lines = {p: p[1:] for p, ok in zip(others, regular.tolist()) if ok and p[0] == "\n" and p[1:].isalpha()}
        rest = [p for p, ok in zip(others, regular.tolist()) if ok and p not in lines]
        marked = np.flatnonzero(plain & (np.asarray(pc.binary_length(bare)) < np.asarray(pc.binary_length(pieces))))
        marks = pc.replace_substring_regex(pieces.take(pa.array(marked)), NO_MARKS, "").dictionary_encode()

        # one table of ids: words, lines, the rest, first pieces, marks, and nothing
        where, *known = self._known_words(words.dictionary)
        parts = [known, self._words(list(lines.values()), "\n"), self._texts_flat([p if p[0] == "\n" else " " + p for p in rest]), self._texts_flat(firsts.dictionary.to_pylist()), self._texts_flat(marks.dictionary.to_pylist())]
        stock, size = np.concatenate([ids for ids, _ in parts]), np.append(np.concatenate([n for _, n in parts]), 0).astype(np.int32)
        base = np.cumsum([0, *(len(n) for _, n in parts)])
        begin = np.append(0, size.cumsum()).astype(np.int32)[:-1]
        nothing = len(size) - 1
        entry, mark = np.full(len(pieces), nothing, np.int32), np.full(len(pieces), nothing, np.int32)
        entry[plain] = where[np.asarray(words.indices)]
        place = {p: base[1] + i for i, p in enumerate(lines)} | {p: base[2] + i for i, p in enumerate(rest)}
        entry[other] = [place.get(p, nothing) for p in others]
        mark[marked] = base[4] + np.asarray(marks.indices)

        # each piece twice, its entry and its marks; then the ids of all texts in one gather
        twice = np.stack([entry[codes], mark[codes]], axis=1)
        twice[ends[:-1], 0], twice[ends[:-1], 1] = base[3] + np.asarray(firsts.indices), nothing
        twice = twice.ravel()
        lengths = size[twice]
        upto = lengths.cumsum(dtype=np.int32)  # a batch is small
        gather = np.repeat(begin[twice] - (upto - lengths), lengths)
        gather += np.arange(upto[-1], dtype=np.int32)
        every = stock[gather]
        stops = np.append(0, upto)[2 * ends].tolist()
        out = [every[a:b] for a, b in zip(stops, stops[1:])]
        odd = np.zeros(len(pieces), bool)
        odd[other[~regular]] = True
        odd = odd[codes]
        odd[ends[:-1]] = False
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(odd), side="right") - 1).tolist():
            out[i] = self._irregular(flat.slice(ends[i], ends[i + 1] - ends[i]).to_pylist())
        for i in self._with_added(texts):
            out[i] = self._by_default(texts[i].as_py())
        return out

    def _with_added(self, texts: pa.Array) -> list[int]:
        held = [np.asarray(pc.fill_null(pc.match_substring(texts.cast(pa.string()), t), False)) for t in self.added]
        return np.flatnonzero(np.any(held, axis=0)).tolist() if held else []

    def _by_default(self, text: str) -> np.ndarray:
        self.whole.encode_special_tokens = False
        try:
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.kind)
        finally:
            self.whole.encode_special_tokens = True

    def _irregular(self, pieces: list[str]) -> np.ndarray:
        """Pieces before which the text must not be cut join the one before them."""
        chunks = [[pieces[0]]]
        for piece in pieces[1:]:
            part = piece if piece[:1] == "\n" else " " + piece
            if _regular(piece):
                chunks.append([part])
            else:
                chunks[-1].append(part)
        return np.frombuffer(b"".join(self._texts(["".join(c) for c in chunks])), dtype=self.kind)


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary, added=True)
    return _encoders[vocabulary]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a bounded number of characters in a column, so that what is made of them stays small."""
    for batch in batches:
        chars = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).cumsum() if batch.num_rows else np.zeros(0)
        at = 0
        while at < batch.num_rows:
            before = chars[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(chars, before + BATCH_CHARS, side="right")))
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()
