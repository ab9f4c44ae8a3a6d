"""Alignment of two tokenizers against a plain version over bytes."""

import hashlib
from collections import Counter

import sentencepiece
from conftest import DATA
from tokenizers import Tokenizer

from tempora.llm import alignment
from tempora.llm.queries import QUERIES, vocabulary

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def vocabularies():
    return vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def brute_force(rows):
    """rows: (doc_id, text). Token by token over byte ranges."""
    path_a, path_b = vocabularies()
    a_model, b_model = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a_model.encode_special_tokens = True
    back = alignment.byte_of_char()
    found, holding = [], Counter()
    for doc_id, text in rows:
        if not text:
            found.append((doc_id, [], [], [], []))
            continue
        encoded = a_model.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(back[c] for c in a_model.id_to_token(i))) for i in encoded.ids]
        b = []
        for i in b_model.encode(text):
            piece = b_model.id_to_piece(i)
            is_byte = len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">")
            b.append((i, bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            found.append((doc_id, [], [], [], []))
            continue

        def ranges(tokens):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out

        ra, rb = ranges(a), ranges(b)
        cuts = sorted({e for *_, e in ra} & {e for *_, e in rb})
        groups, low = [], 0
        for c in cuts:
            inside = lambda r: ",".join(str(i) for i, s, e in r if s >= low and e <= c)  # noqa: B023, E731
            groups.append(f"{inside(ra)}|{inside(rb)}")
            low = c
        links = [(i, j) for i, s, e in ra for j, u, v in rb if s < v and u < e]
        holding.update(set(links))
        found.append((doc_id, a, b, groups, links))
    highest = Counter()
    for (i, _), n in holding.items():
        highest[i] = max(highest[i], n)
    return [
        (doc_id, len(a), len(b), len(groups), len(links), sum(holding[x] == highest[x[0]] for x in links), sum(holding[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for doc_id, a, b, groups, links in found
    ]


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


TEXTS = ["Plain words, plain words.", "été naïve Ünïcode 東京 日本 😀😀", "two  spaces and\ttabs\nlines", "x" * 300, "<|endoftext|> is text, </s> too", "", None, " lead", "a▁b", "ﬁne ½",
         "internationalisation misalignments 1234567890123", "Plain words, plain words.", "é combining", "\x00 nul", "don't can't we'll"]


def test_awkward_texts_against_brute_force(spark):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1])] * 2
    data = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, rid int, pairs string")
    df, pairs = alignment.align_tokenizers(data, *vocabularies())
    assert result(df) == sorted(brute_force(rows), key=repr)
    assert pairs.filter("count > 2").count() > 0


def test_small_corpus_against_brute_force(spark, duck):
    rows = duck.execute("select doc_id, text from documents where length(text) < 2500 order by doc_id").fetchall()
    data = spark.createDataFrame(rows, "doc_id long, text string")
    df, _ = alignment.align_tokenizers(data, *vocabularies())
    found = result(df)
    assert found == sorted(brute_force(rows), key=repr) and sum(r[4] for r in found) > 10_000


def test_cold_and_hot_pairs_agree(spark, monkeypatch):
    data = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").limit(40)
    by_broadcast = result(alignment.align_tokenizers(data, *vocabularies())[0])
    monkeypatch.setattr(alignment, "HOT", 200)
    assert result(alignment.align_tokenizers(data, *vocabularies())[0]) == by_broadcast
    monkeypatch.setattr(alignment, "HOT", 1)
    assert result(alignment.align_tokenizers(data, *vocabularies())[0]) == by_broadcast


def test_no_rows(spark):
    df, pairs = alignment.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), *vocabularies())
    assert df.count() == 0 and pairs.count() == 0


def test_long_text_and_query(spark):
    data = spark.createDataFrame([(1, "word überlang " * 40_000)], "doc_id long, text string")
    row = alignment.align_tokenizers(data, *vocabularies())[0].first()
    assert row.n_a > 40_000 and row.n_links >= max(row.n_a, row.n_b)
    assert QUERIES["op11_token_alignment"](spark, f"{DATA}/sf0.001").count() == 200
