"""License scans against a plain version over all blocks, and awkward texts."""

import random
import re

import pytest

from tempora.llm import licenses

SCHEMA = "doc_id long, text string, rid int, words string, known string, blocks string"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts, templates, threshold):
    """(doc_id, number of words, base places, matches) of every text, block by block and template by template."""
    out = []
    ready = licenses.compiled(templates, threshold)
    for doc_id, text in texts:
        words = re.findall(WORD, (text or "").translate(UPPER))
        places = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        matches = set()
        for t in ready:
            half = t["width"] // 2
            for no in range(max(-(-len(words) // half) - 1, 1)):
                shared = len(set(words[no * half : no * half + t["width"]]) & set(t["words"]))
                if shared >= threshold * len(t["words"]) - 1e-9:
                    matches.add((t["width"], no, t["label"], shared / len(t["words"])))
        out.append((doc_id, len(words), places, sorted(matches)))
    return sorted(out, key=repr)


def found(spark, texts, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    data = spark.createDataFrame([(i, t, 1, "a", "b", "c") for i, t in texts], SCHEMA)
    rows = licenses.license_scan(data, templates, threshold=threshold).collect()
    return sorted(((r.doc_id, r.n_words, [tuple(p) for p in r.places], sorted({tuple(m) for m in r.matches})) for r in rows), key=repr)


def test_awkward_texts(spark):
    texts = [None, "", " \n\t", "MIT License", "mit-license, the GENERAL public\nlicense and Apache (License)", "the mit license mit license", "İMIT license K mit licenseÉ mit é license",
             "Released under the MİT License", "word " * 30_000 + "Released under the MIT License. " + "word " * 500, "under the released MIT works' License", "license mit",
             " ".join(t for _, t in licenses.TEMPLATES), "Licensed under CC BY-NC 4.0"]
    rows = list(enumerate(texts)) + [(None, "MIT License"), (3, "MIT License"), (3, "MIT License")]
    result = found(spark, rows)
    assert result == plain(rows, licenses.TEMPLATES, licenses.THRESHOLD)
    assert {m[2] for r in result if r[0] == 11 for m in r[3]} == {label for label, _ in licenses.TEMPLATES}


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.5), (2, 0.75), (3, 1.0)])
def test_random_sets_against_brute_force(spark, seed, threshold):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(14)]
    weights = [1 / (i + 1) for i in range(14)]
    templates = tuple((f"t{i}", " ".join(rng.choices(vocabulary, weights, k=rng.choice([2, 5, 8, 12, 20])))) for i in range(9))
    texts = [(i, " ".join(rng.choices(vocabulary + ["other"] * 4, weights + [0.4] * 4, k=rng.randrange(0, 120)))) for i in range(150)]
    result = found(spark, texts, templates, threshold)
    assert result == plain(texts, templates, threshold) and (threshold == 1.0 or sum(len(r[3]) for r in result) > 50)


def test_no_rows_and_wrong_parameters(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert licenses.license_digests(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.license_scan(empty, threshold=0)
    with pytest.raises(ValueError):
        licenses.license_scan(empty, (("none", "..."),))


def test_digests(spark):
    data = spark.createDataFrame([(1, "x " * 50 + "This work is licensed under the GNU General Public License, version 3"), (2, "Released\nunder the; MIT License"), (3, "plain"), (4, "Licensed under CC BY-NC 4.0!")], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.license_digests(data).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].base_labels, rows[1].labels, rows[1].score) == (1, 57, "gpl", "GPL-3.0,gpl", 1.0)
    assert (rows[2].base_labels, rows[2].labels) == ("mit", "MIT,mit")
    assert (rows[3].labels, rows[3].score, rows[3].first_word) == ("", 0.0, None)
    assert (rows[4].base_labels, rows[4].labels, rows[4].score) == ("", "CC-BY-NC-4.0", 1.0)
