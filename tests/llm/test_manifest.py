"""The Merkle manifest against a plain tree, awkward rows, and proofs of single rows."""

import hashlib
import zlib

import pytest
from conftest import DATA

from tempora.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, digest string, level int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root of a list of digests, and for each of them the siblings with their sides."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            s = k ^ 1
            paths[i].append((bool(k & 1), nodes[s] if s < len(nodes) else None))
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [k // 2 for k in at]
    return nodes[0], paths


def plain(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    out, roots, held = [], [], []
    for lang in langs:
        mine = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        root, paths = tree([leaf(*r) for r in mine])
        roots.append(root)
        held.append((mine, paths))
    top, over = tree(roots)
    for (mine, paths), root, more in zip(held, roots, over):
        for r, p in zip(mine, paths):
            path = p + more
            spoilt = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            acc = leaf(*r[:4], r[4] + 1) if spoilt else leaf(*r)
            for left, s in path:
                acc = sha(*((s or "", acc) if left else (acc, s or "")))
            out.append((r[0], leaf(*r), root, top, sha("".join(s or "" for _, s in path)), acc, acc == top))
    return sorted(out, key=repr)


def check(spark, rows):
    data = spark.createDataFrame([(*r, "clash", 7, "x", 3) for r in rows], SCHEMA).repartition(5)
    found = manifest.manifest_digests(data)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(rows)


# one block, a full one, one row over it, several blocks with a lone last row, two buckets and a part of a third
@pytest.mark.parametrize("sizes", [(1,), (2, 1), (64, 65), (129, 3, 64), (4097, 1, 2)])
def test_sizes(spark, sizes):
    rows = [(i * 3 - 5, f"text {i}", f"l{k}", f"s{i % 3}", i) for k, n in enumerate(sizes) for i in range(n)]
    check(spark, rows)


def test_awkward_rows(spark):
    rows = [(None, None, None, None, None), (None, "a", None, "", 0), (1, "", "en", None, None), (1, "", "en", None, None), (1, "x", "en", "s", 1), (-4, "é😀" * 9000, "é", "z", 3),
            (7, "t", "-", "-", None), (8, "t", "", "=", 2), (14, "t", "=", "", 2), (9, "t", "Z", "", 2)] + [(k, "same", "fr", "s", 4) for k in range(70)] + [(5, "same", "fr", "s", 4)] * 3
    check(spark, rows)


def test_many_languages(spark):
    check(spark, [(i, f"t{i}", f"lang-{i:03}", "s", i) for i in range(150)])


def test_no_rows(spark):
    assert manifest.manifest_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_paths_prove_rows_and_only_those(spark):
    rows = manifest.merkle_manifest(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")).collect()
    assert len({r.root for r in rows}) == 1 and {r["rank"] for r in rows if r.lang == rows[0].lang} == set(range(sum(r.lang == rows[0].lang for r in rows)))
    for r in rows:
        for start, holds in ((r.leaf, True), (r.spoilt or sha("other"), False)):
            acc = start
            for s in r.path:
                acc = sha(*((s.sibling or "", acc) if s.left else (acc, s.sibling or "")))
            assert (acc == r.root) is holds
