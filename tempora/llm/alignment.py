"""Alignment of two tokenizers' ids over the same bytes.

A text is encoded by a byte-level BPE (A, with a space before the text) and a piece model (B, which adds that space itself). Every token stands
for bytes, so cumulative lengths are the byte offsets where tokens end. Two dictionaries, from end to token index, are intersected
as hash sets: the sorted common keys cut both id lists into groups that cover the same bytes, and the links (A-B pairs of
overlapping tokens) are expanded group by group. Both tokenizers end a token before a space that follows a character, so a text is cut there into
runs; no group reaches over such a cut, and each distinct run of a batch is encoded and aligned once, with a bounded memory of runs.

The corpus-wide count of an id pair is the number of documents that hold it linked. Texts are encoded once: every document's
distinct pairs, with how often each occurs, are written to the shared folder. Counts come from those by a partial sum in each task. Going back
to the documents, pairs that are hot (more than 1 / HOT of all document-pair rows, so there are fewer than HOT of them) are broadcast, the
others are joined by shuffling: most links are of hot pairs, and no common pair meets in one task. Every row has a number of its own as key.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .hashing import text_chunks

#: There are fewer hot pairs than this, so their broadcast is bounded.
HOT = 1 << 18
FACTS = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<bigint>"
#: Runs remembered by a Python worker before it starts anew.
MAX_RUNS = 500_000
#: Runs laid end to end to be encoded.
JOINED = 500
#: Where a text may be cut, and what makes the plain cut at every space wrong: a space at the start or after white space.
SPACED, ODD = re.compile(r"(?<=\S) "), re.compile(r"^\s|\s ")
#: A pair is one number: the A id times this, and the B id.
STRIDE = 1 << 32

_aligners: dict[tuple[str, str], "Aligner"] = {}


def aligner(path_a: str, path_b: str) -> "Aligner":
    """The worker's aligner for two vocabulary files."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others are numbered from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.a.get_vocab_size(with_added_tokens=True)
        back = byte_of_char()
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(back[c] for c in e) if all(c in back for c in e) else b"" for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [piece_bytes(p, self.b.is_byte(i)) for i, p in enumerate(pieces)]
        # no token of B reaches from another character over a space, so B's tokens too can be found run by run
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.width_a = np.array([len(x) for x in self.bytes_a])
        self.width_b = np.array([len(x) for x in self.bytes_b])
        # an id as text, with what follows it: for A a comma or the bar before B's ids, for B a comma or the end of the group
        self.text = np.array([f"{i}{end}" for ids, ends in ((size, ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(ids)], object)
        self.at = {"a,": 0, "a|": size, "b,": 2 * size, "b;": 2 * size + len(self.bytes_b)}
        self.forget()

    def forget(self) -> None:
        """Begin anew with runs known."""
        self.place: dict[str, int] = {}
        self.written: list[str] = []
        self.sizes = np.zeros((1 << 14, 4), np.int64)  # A tokens, B tokens, groups, links (-1 each: bytes differ)
        self.starts = np.zeros(1 << 14, np.int64)
        self.links = np.zeros(1 << 16, np.int64)
        self.used = 0

    def runs(self, text: str) -> list[str]:
        """The text cut at spaces where both tokenizers end a token, whatever stands around: after a character that is no white space."""
        if not self.cuts or text.endswith(" "):
            return [text]
        return SPACED.split(text) if ODD.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers for every text with a space before it; None where the joined bytes differ from it."""
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        spaced = [" " + t for t in texts]
        for t, a, b in zip(spaced, self.a.encode_batch_fast(spaced, add_special_tokens=False), self.b.encode(texts, num_threads=1)):
            raw = t.encode()
            same = b"".join(map(of_a, a.ids)) == raw and b"".join(map(of_b, b)) == raw
            yield (np.array(a.ids, np.int64), np.array(b, np.int64)) if same else None

    def learn(self, runs: list[str]) -> None:
        """Align runs that are not known, many of them laid end to end: every run's end is a common one."""
        # one that ends in white space, the last of its text, could share a token with the space after it
        plain = [r for r in runs if r and not r[-1].isspace()] if len(runs) > 1 else []
        for run in runs if not plain else [r for r in runs if not r or r[-1].isspace()]:
            self.remember([run], next(self.encode([run])))
        chunks = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for chunk, ids in zip(chunks, self.encode([" ".join(c) for c in chunks])):
            if ids:
                self.remember(chunk, ids)
            else:  # the bytes of some run differ
                for run in chunk:
                    self.learn([run])

    def remember(self, runs: list[str], ids: tuple[np.ndarray, np.ndarray] | None) -> None:
        a, b = ids or (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ends_a, ends_b, cut_a, cut_b = self.groups(a, b)
        i, j = linked(ends_a, ends_b, cut_a, cut_b)
        stops = np.cumsum([len(r.encode()) + 1 for r in runs])
        # tokens, groups and links up to the end of each run
        to_a, to_b = np.searchsorted(ends_a, stops, "right"), np.searchsorted(ends_b, stops, "right")
        groups, links = np.searchsorted(cut_a, to_a, "right"), np.searchsorted(i, to_a, "left")
        counts = np.diff(np.stack([to_a, to_b, groups, links], 1), axis=0, prepend=0)
        parts = self.written_groups(a, b, cut_a, cut_b).split(";")
        upto, first = groups.tolist(), len(self.written)
        self.place.update(zip(runs, range(first, first + len(runs))))
        self.written += [parts[x] if y == x + 1 else ";".join(parts[x:y]) for x, y in zip([0, *upto], upto)]
        self.sizes = put(self.sizes, first, counts if ids else np.full((1, 4), -1))
        self.starts = put(self.starts, first, self.used + links - counts[:, 3])
        self.links = put(self.links, self.used, a[i] * STRIDE + b[j])
        self.used += len(i)

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
        """Of every text: its numbers of A tokens, B tokens, groups and links, its groups as text, and its links, one pair each."""
        cut = [self.runs(t) for t in texts]
        if len(self.place) > MAX_RUNS or self.used > 8 * MAX_RUNS:
            self.forget()
        seen = set(chain.from_iterable(cut))
        if new := [r for r in seen if r not in self.place]:
            self.learn(new)
        get = self.place.__getitem__
        for text, runs in zip(texts, cut):
            at = np.fromiter(map(get, runs), np.int64, len(runs))
            sizes = self.sizes[at]
            if not text or (sizes[:, 1] < 0).any():
                yield np.zeros(4, np.int64), "", np.zeros(0, np.int64)
                continue
            n = sizes[:, 3]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield sizes.sum(0), ";".join(map(self.written.__getitem__, at.tolist())), self.links[np.repeat(self.starts[at], n) + inside]

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ends of both lists' tokens in bytes, and for each group the number of A and of B tokens up to its end."""
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        at_a, at_b = dict(zip(ends_a.tolist(), range(1, len(a) + 1))), dict(zip(ends_b.tolist(), range(1, len(b) + 1)))
        common = sorted(at_a.keys() & at_b.keys())
        cut_a, cut_b = (np.fromiter((at[k] for k in common), np.int64, len(common)) for at in (at_a, at_b))
        return ends_a, ends_b, cut_a, cut_b

    def written_groups(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """The groups as ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        code_a, code_b = a + self.at["a,"], b + self.at["b,"]
        code_a[cut_a - 1] = a[cut_a - 1] + self.at["a|"]
        code_b[cut_b - 1] = b[cut_b - 1] + self.at["b;"]
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(cut_b - n_b, n_a)] = code_a
        out[np.arange(len(b)) + np.repeat(cut_a, n_b)] = code_b
        return "".join(self.text[out].tolist())[:-1]


def put(held: np.ndarray, at: int, rows: np.ndarray) -> np.ndarray:
    """``held``, grown if need be, with the rows from ``at`` on."""
    if at + len(rows) > len(held):
        held = np.concatenate([held, np.zeros((at + len(rows), *held.shape[1:]), held.dtype)])
    held[at : at + len(rows)] = rows
    return held


def linked(ends_a: np.ndarray, ends_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all links in A's order, slice by slice: where one side of a slice is one token, it meets all of the other; else by their ends."""
    n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    first_a, first_b = cut_a - n_a, cut_b - n_b
    plain = (n_a == 1) | (n_b == 1)
    n = np.where(plain, n_a * n_b, 0)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out_a = np.repeat(first_a, n) + np.where(np.repeat(n_b == 1, n), inside, 0)
    out_b = np.repeat(first_b, n) + np.where(np.repeat(n_b == 1, n), 0, inside)
    more_a, more_b = [], []
    for g in np.flatnonzero(~plain).tolist():
        i, j = int(first_a[g]), int(first_b[g])
        while i < cut_a[g] and j < cut_b[g]:
            more_a.append(i)
            more_b.append(j)
            end_a, end_b = ends_a[i], ends_b[j]
            i += int(end_a <= end_b)
            j += int(end_b <= end_a)
    i, j = (np.append(x, np.array(more, np.int64)) for x, more in ((out_a, more_a), (out_b, more_b)))
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def aligned_documents(documents: DataFrame, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """FACTS of every row: its number, doc_id, counts, the groups' digest, and its distinct linked pairs with how often each occurs. Written."""
    rows = documents.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(vocabulary_a, vocabulary_b)
        for batch in batches:
            texts = batch.column("text")
            for start, _, ends in text_chunks(texts):
                part = batch.slice(start, len(ends))
                counts, digests, pairs, times = [], [], [], []
                for sizes, groups, links in both.align(part.column("text").to_pylist()):
                    found, often = np.unique(links, return_counts=True)
                    counts.append(sizes)
                    digests.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                    pairs.append(found)
                    times.append(often)
                n = np.stack(counts)
                at = pa.array(np.append(0, np.cumsum([len(x) for x in pairs])), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x), pa.int64())) for x in (pairs, times)]
                columns = [part.column("rid"), part.column("doc_id"), *(pa.array(n[:, k]) for k in range(4)), pa.array(digests), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return written(rows.mapInArrow(align, FACTS), "aligned")


def pair_counts(facts: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best (whether no pair of its A id has a higher count), written."""
    counts = written(facts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pair-counts")
    keyed = counts.withColumn("a", F.floor(F.col("pair") / STRIDE))
    highest = keyed.groupBy("a").agg(F.max("count").alias("highest"))
    return written(keyed.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "pairs")


def align_tokenizers(documents: DataFrame, vocabulary_a: str, vocabulary_b: str) -> tuple[DataFrame, DataFrame]:
    """Results by document (FACTS, n_best, count_sum) and the corpus's pairs (pair = A id * STRIDE + B id, count, best).

    n_best: links whose pair's count is the highest of its A id. count_sum: the pairs' counts summed over links. A null or empty text, or one
    whose tokens do not give back its bytes, has zeros, no pairs and an empty digest. Repeated rows count as documents of their own;
    null ids stay null; no rows give no rows; other columns are not read. Long texts are aligned whole.
    """
    facts = aligned_documents(documents, vocabulary_a, vocabulary_b)
    pairs = pair_counts(facts)
    total = facts.agg(F.sum(F.size("pairs").cast("long"))).first()[0] or 0
    held = facts.select("rid", F.arrays_zip("pairs", "times").alias("x")).select("rid", F.explode("x").alias("x")).select("rid", F.col("x.pairs").alias("pair"), "x.times")
    is_hot = F.col("count") * HOT > total
    hot = F.broadcast(pairs.filter(is_hot))
    cold = held.join(F.broadcast(pairs.filter(is_hot).select("pair")), "pair", "left_anti").join(pairs.filter(~is_hot).hint("merge"), "pair")
    sums = [F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    # each side is summed by row before it is dealt out
    found = held.join(hot, "pair").groupBy("rid").agg(*sums).unionByName(cold.groupBy("rid").agg(*sums))
    per_row = found.groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    rows = facts.join(per_row, "rid", "left")
    return rows.withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")}), pairs
