"""Token ids of whole texts, batch by batch, with a bounded memory of pieces already encoded.

Both public vocabularies split a text at white space before merging, so a text's ids are those of its
white-space-delimited pieces put together. Each distinct piece of a batch is encoded once by the ``tokenizers``
library; texts that hold an added token of the vocabulary, or white space that could be joined across pieces, go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered by a Python worker before it starts anew.
MAX_PIECES = 1_000_000
#: Marks where a text is cut; a text that has it goes to the library whole.
CUT = "\x1f"
SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]"
#: A letter and what follows it up to here never share a token: ASCII digits and punctuation, but for the apostrophe.
AFTER_LETTER = r"[!-&(-@\[-`{-~]"
#: Words that are one unit before merging, whatever the vocabulary's normalisation.
PLAIN = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: Bytes of text handled at a time.
CHUNK_BYTES = 8_000_000

_encoders: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, spaced: bool, max_pieces: int = MAX_PIECES) -> "Encoder":
    """The worker's encoder for a vocabulary file. spaced: a piece keeps the space before it (byte-level BPE)."""
    key = (path, spaced)
    if key not in _encoders:
        _encoders[key] = Encoder(path, spaced)
    _encoders[key].max_pieces = max_pieces
    return _encoders[key]


class Encoder:
    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # ids that begin a word after a space, or that end a word
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if spaced else t.endswith("</w>"))]] = True
        self.plain = re.compile(f" {PLAIN}" if spaced else PLAIN)
        self.max_pieces = MAX_PIECES
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.counts = np.empty(1 << 14, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of plain words and how many each has, from texts of many words, which are told apart by the ids at their edges."""
        texts = [("" if self.spaced else " ").join(pieces[i : i + 500]) for i in range(0, len(pieces), 500)]
        flat = np.concatenate([np.array(x, np.uint32) for x in self.whole(texts)])
        at = np.flatnonzero(self.edge[flat])
        counts = np.diff(at, append=len(flat)) if self.spaced else np.diff(at, prepend=-1)
        return (flat, counts) if len(counts) == len(pieces) else None

    def learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if self.plain.fullmatch(p)]
        rest = [p for p in pieces if not self.plain.fullmatch(p)] if len(plain) < len(pieces) else []
        for some, is_plain in [(x[i : i + 50_000], x is plain) for x in (plain, rest) for i in range(0, len(x), 50_000)]:
            found = self.joined(some) if is_plain else None
            if not found:
                lists = self.whole(some)
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                found = np.fromiter((i for x in lists for i in x), np.uint32, int(counts.sum())), counts
            flat, counts = found
            n, k = len(self.place), len(some)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            while n + k > len(self.starts):
                self.starts, self.counts = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.counts, 2 * len(self.counts))
            self.ids[self.used : self.used + len(flat)] = flat
            self.starts[n : n + k] = self.used + np.cumsum(counts) - counts
            self.counts[n : n + k] = counts
            self.place.update(zip(some, range(n, n + k)))
            self.used += len(flat)

    def places(self, pieces: list[str]) -> np.ndarray:
        if len(self.place) + len(pieces) > self.max_pieces:
            self.forget()
        get = self.place.get
        found = [get(p, -1) for p in pieces]
        if new := [p for p, at in zip(pieces, found) if at < 0]:
            self.learn(new)
            found = [get(p) for p in pieces]
        return np.array(found, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the number of ids of each.

        Pieces also end between a letter and what never shares a token with it: far fewer differ.
        """
        odd = pc.match_substring(texts, CUT)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        if self.spaced:
            odd = pc.or_(odd, pc.match_substring_regex(texts, rf"{SPACE} | {SPACE}|^{SPACE}"))
        odd = odd.to_numpy(zero_copy_only=False)
        easy = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        easy = pc.replace_substring_regex(easy, rf"(\pL)({AFTER_LETTER})", rf"\1{CUT}\2")
        easy = pc.replace_substring(easy, " ", f"{CUT} ") if self.spaced else pc.replace_substring_regex(easy, r"[ \t\n\r\f\v]+", CUT)
        parts = pc.split_pattern(easy, CUT)
        ends = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        flat = parts.flatten()
        coded = flat.dictionary_encode()
        at = self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        counts = self.counts[at]
        total = int(counts.sum())
        begins = np.cumsum(counts) - counts
        ids = self.ids[np.repeat(self.starts[at] - begins, counts) + np.arange(total)]
        per_text = np.add.reduceat(np.append(counts, 0), ends[:-1]) if len(flat) else np.zeros(len(texts), np.int64)
        per_text[ends[:-1] == ends[1:]] = 0
        if odd.any():
            own = self.whole([texts[int(i)].as_py() for i in np.flatnonzero(odd)])
            pieces = np.split(ids, np.cumsum(per_text)[:-1])
            for i, x in zip(np.flatnonzero(odd), own):
                pieces[i], per_text[i] = np.array(x, np.uint32), len(x)
            ids = np.concatenate(pieces)
        return ids, per_text


def text_chunks(texts: pa.Array, chunk_bytes: int):
    """Slices (start, stop) of a text column of at most chunk_bytes each, or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > chunk_bytes:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def encoded_batches(batches, path: str, spaced: bool, end_id: int, max_pieces: int = MAX_PIECES, chunk_bytes: int = CHUNK_BYTES):
    """For each chunk of the batches: the chunk, and each text's ids with the end id."""
    coder = encoder(path, spaced, max_pieces)
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
        for i, j in text_chunks(texts, chunk_bytes):
            part = texts.slice(i, j - i)
            ids, counts = coder.encode(part)
            cuts = np.cumsum(counts)
            with_end = np.insert(ids, cuts, end_id)
            yield batch.slice(i, j - i), np.split(with_end, (cuts + np.arange(1, len(cuts) + 1))[:-1])
