import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd

from skein.llm import langid as q
from tests.llm.fixtures import docs, table


def test_binding_rolls_and_multiplies():
    a, b, c = (q.letter_vector(ord(x)) for x in "abc")
    got = q.bind(np.array([[97, 98, 99]]))[0]
    assert (got == np.roll(a, 2) * np.roll(b, 1) * c).all()
    assert abs(int((got.astype(int) * q.bind(np.array([[98, 97, 99]]))[0]).sum())) < 0.3 * q.DIMENSIONS


def test_bundle_is_the_sum_of_its_grams():
    text = "Ab, ab! ça 7x"
    brute = np.zeros(q.DIMENSIONS)
    s = " ab ab ça x "
    for i in range(len(s) - 2):
        brute += np.prod([np.roll(q.letter_vector(ord(ch)), 2 - k) for k, ch in enumerate(s[i : i + 3])], axis=0)
    assert np.allclose(q.bundles([text])[0], brute)
    assert np.allclose(q.bundles([text], q.GramTable(rows=2))[0], brute)
    assert not q.bundles(["", "12 !"]).any()


def test_many_letters_take_little_memory():
    """128 texts of random Han letters, nearly all trigrams distinct: the sums are right and no table of texts x trigrams is made."""
    rng = random.Random(4)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3000)) for _ in range(128)]
    small = [t[:40] for t in texts[:5]]
    table = q.GramTable()
    alone = np.stack([q.bundles([t], q.GramTable(rows=10))[0] for t in small])
    assert np.allclose(q.bundles(small, q.GramTable(rows=10)), alone)
    tracemalloc.start()
    q.bundles(texts, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20, peak


def test_awkward_rows(spark, tmp_path):
    texts = ["the cat and the dog"] * 20 + ["le chat et le chien"] * 20 + [None, "", "123 ?!", "the " * 40000, "中文 字"]
    d = docs(spark, texts).withColumn("lang", q.F.expr("case when doc_id < 20 then 'en' when doc_id < 40 then 'fr' end"))
    got = q.op7_language_id(spark, table(spark, tmp_path, "documents", d)).toPandas().set_index("doc_id").sort_index()
    assert len(got) == len(texts)
    assert (got.lang_pred[:20] == "en").all() and (got.lang_pred[20:40] == "fr").all()
    assert (got.lang_pred[40:43] == "und").all() and (got.score[40:43] == 0).all()
    assert got.lang_pred[43] == "en" and got.score.between(0, 1).all()
    assert got.held_out.tolist() == [q.crc_fold(i) for i in range(len(texts))]


def test_nothing_to_learn(spark, tmp_path):
    d = docs(spark, ["abc", None]).withColumn("lang", q.F.lit(None).cast("string"))
    got = q.op7_language_id(spark, table(spark, tmp_path, "documents", d)).collect()
    assert {r.lang_pred for r in got} == {"und"}
    assert q.op7_language_id(spark, table(spark, tmp_path, "documents", docs(spark, []))).count() == 0


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    truth = pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "lang"]]
    got = q.op7_language_id(spark, sf).toPandas().merge(truth, on="doc_id")
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.96


def brute(texts, langs, ids):
    """Predictions one n-gram at a time: (language, score) of each text."""
    letters = {}

    def vector(ch):
        if ch not in letters:
            letters[ch] = q.letter_vector(ord(ch)).astype(float)
        return letters[ch]

    def bundle(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        line, v = " " + " ".join(words) + " ", np.zeros(q.DIMENSIONS)
        for i in range(len(line) - 2) if words else ():
            v += np.roll(vector(line[i]), 2) * np.roll(vector(line[i + 1]), 1) * vector(line[i + 2])
        return v

    made = [bundle(t) for t in texts]
    profiles = {}
    for i, lang, v in zip(ids, langs, made):
        if i is not None and lang and v.any() and zlib.crc32(str(i).encode()) % 5:
            profiles[lang] = profiles.get(lang, 0) + v / np.linalg.norm(v)
    out = []
    for v in made:
        cos = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in profiles.items()} if v.any() else {}
        best = min(cos, key=lambda k: (-round(cos[k], 6), k)) if cos else "und"
        out.append((best, max(0.0, min(1.0, cos[best])) if cos else 0.0))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    speech = {"en": "the and of house ring song".split(), "fr": "le et de maison être ça".split(), "de": "der und ein Straße groß".split()}
    texts, langs = [], []
    for i in range(90):
        lang = rng.choice(sorted(speech))
        texts.append(rng.choice([None, "", "12 %", *[" ".join(rng.choices(speech[lang], k=rng.randint(1, 30))) + rng.choice([".", " 7x!", "\n", "  "]) for _ in range(12)]]))
        langs.append(rng.choice([None, lang, lang, lang, lang]))
    ids = [*range(88), None, 5]
    sf = table(spark, tmp_path, "documents", spark.createDataFrame(list(zip(ids, texts, langs)), "doc_id long, text string, lang string").coalesce(1))
    got = q.op7_language_id(spark, sf).collect()
    want = brute(texts, langs, ids)
    key = lambda x: (x[0] is None, x[0] or 0, x[1], round(x[2], 4))
    mine = sorted(((r.doc_id, r.lang_pred, r.score) for r in got), key=key)
    theirs = sorted(((i, p, s) for i, (p, s) in zip(ids, want)), key=key)
    assert [x[:2] for x in mine] == [x[:2] for x in theirs]
    assert np.allclose([x[2] for x in mine], [x[2] for x in theirs], atol=2e-4)
    assert {r.doc_id for r in got if r.held_out} == {i for i in ids if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
