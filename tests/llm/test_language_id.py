import zlib
from collections import Counter

import numpy as np
from llm_helpers import DOCS

from tallywright.llm import language_id as lid


def test_held_out_accuracy(spark):
    got = lid.query(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.n_chars > 20]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def plain(text):
    """The trigram counts of a text."""
    line = [0]
    for c in (text or "").lower() + " ":
        if c.isalpha() or line[-1]:
            line.append(ord(c) if c.isalpha() else 0)
    return Counter(a << 42 | b << 21 | c for a, b, c in zip(line, line[1:], line[2:]))


def test_counts_and_vectors_are_the_plain_ones(monkeypatch):
    texts = ["Hé, wie GEHT's?", "", None, "...", "aaaa", "x" * 5000 + " ÿ", "一二三 и ё", "a  . , b" * 400 + "   " * 300 + "z"]
    for group in (1 << 20, 64, 3):
        monkeypatch.setattr(lid, "GROUP", group)
        got = [Counter() for _ in texts]
        for start, trigrams, text, place, counts in lid.counted(texts):
            for k, t, n in zip(text.tolist(), trigrams[place].tolist(), counts.tolist()):
                got[start + k][t] += n
        assert got == [plain(t) for t in texts]
    v = lid.letter_vectors(np.array([97, 98, 0x4E00]), 64).astype(int)
    one = lid.trigram_vectors(np.array([97 << 42 | 98 << 21 | 0x4E00]), 64)[0]
    assert (one == np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]).all() and set(v.ravel()) == {-1, 1}
    kept = lid.Vectors(64)
    for t in (np.array([5, 9, 70_000]), np.array([9, 11]), np.arange(40_000), np.arange(9_000), np.arange(8_000, 18_000)):
        assert (kept.of(t) == lid.trigram_vectors(t, 64)).all()
    own = lid.bundled(texts, kept)
    for k, t in enumerate(texts):
        assert (own[k] == sum((n * lid.trigram_vectors(np.array([g]), 64)[0].astype(int) for g, n in plain(t).items()), np.zeros(64))).all()


def test_bundles_by_owner_are_sums():
    texts = ["one two three", "deux et trois", None, "four", "cinq"]
    v = lid.Vectors(64)
    each = lid.bundled(texts, v)
    assert (lid.bundled(texts, v, np.array([0, 1, 1, 0, 1])) == np.stack([each[[0, 3]].sum(axis=0), each[[1, 2, 4]].sum(axis=0)])).all()


def test_every_letter_has_its_own_vector():
    points = np.concatenate([np.arange(97, 123), np.arange(0xE0, 0x100), np.arange(0x430, 0x450), np.arange(0x4E00, 0x5E00)])
    v = lid.letter_vectors(points, 1024).astype(np.float32)
    cosines = v @ v.T / 1024 - np.eye(len(v), dtype=np.float32)
    assert np.abs(cosines).max() < 0.2


def test_scripts_other_than_latin(spark):
    """Languages that share a script, on short texts: words of random syllables, as the tables here have Latin ones only."""
    rng = np.random.default_rng(2)
    scripts = {"x1": range(0x430, 0x450), "x2": range(0x430, 0x450), "y1": range(0x4E00, 0x4E80), "y2": range(0x4E00, 0x4E80), "z": range(0x5D0, 0x5EB)}
    syllables = {lang: ["".join(map(chr, rng.choice(list(points), 3))) for _ in range(60)] for lang, points in scripts.items()}
    docs = []
    for i in range(2000):
        lang = list(scripts)[i % 5]
        docs.append((i, " ".join("".join(rng.choice(syllables[lang], 2)) for _ in range(3)), lang, "s", 20))
    rows = lid.identify(spark.createDataFrame(docs, DOCS)).collect()
    held = [r for r in rows if zlib.crc32(str(r.row.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == r.row.lang for r in held]) > 0.97


def test_edges(spark, edge, empty, clashing):
    got = lid.identify(clashing)
    assert got.select("row.*").columns == clashing.columns and got.count() == clashing.count()
    told = {r.row.doc_id: r for r in lid.identify(edge).collect()}
    assert all(told[d].lang_pred == "und" and told[d].score == 0 for d in (1, 2, 3))
    assert told[9].lang_pred == "en"
    assert lid.identify(empty).count() == 0 and lid.known_language(empty).columns == empty.columns
    untaught = spark.createDataFrame([(1, "some text", None, "s", 1)], DOCS)
    assert [r.lang_pred for r in lid.identify(untaught).collect()] == ["und"]
    assert {r.doc_id for r in lid.known_language(edge).collect()} == {None, 5, 7, 8, 9, 0, -4}
