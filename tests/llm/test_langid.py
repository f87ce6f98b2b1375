"""Language id: held-out accuracy, centroids against brute force, rejection, edge rows."""

import binascii

import numpy as np

from iolens.llm import langid as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = L.op4_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    langs = {r.lang for r in docs.values()}
    good = total = 0
    for r in rows:
        assert r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred in langs | {"und"} and 0 <= r.score <= 1
        if r.held_out:
            total += 1
            good += r.lang_pred == docs[r.doc_id].lang
    assert good >= 0.97 * total
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert sum(r.rejected for r in rows if r.doc_id in clean) <= 0.005 * len(clean)


def test_features_are_trigrams_by_definition():
    text = "Ab, éX!  12"
    b = b" ab \xc3\xa9x "
    want = [(((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) * 2654435761) & 0xFFFFFFFF) >> (32 - L.BITS) for k in range(len(b) - 2)]
    assert L.grams(text).tolist() == want
    count, size = L.counts([text, "", "."])
    assert size.tolist() == [len(want), 0, 0] and count[0].sum() == len(want)
    idf = np.linspace(1, 2, L.DIM).astype(np.float32)
    v = L.vectors(count, idf)
    raw = np.where(count[0] > 0, 1 + np.log(np.maximum(count[0], 1)), 0) * idf
    assert np.allclose(v[0], raw / np.linalg.norm(raw), atol=1e-6) and not v[1].any()


def test_nearest_centroid_and_rejection(spark):
    words = {"aa": "lorem ipsum dolor amet sit", "bb": "wuz gryx fnop qwk jjet zzub"}
    rows = [(k, " ".join(words[x].split()[(k + j) % 5] for j in range(40)), x) for k in range(60) for x in words]
    train = spark.createDataFrame([(t, x) for _, t, x in rows], "text string, lang string")
    m = L.fit(train, clusters=2, sample=20)
    assert sorted(set(m.langs)) == ["aa", "bb"] and np.allclose(np.linalg.norm(m.centroids, axis=1), 1, atol=1e-5)
    lang, score, bad = m.predict([rows[0][1], rows[1][1], "ччч щщщ ъъъ ыыы " * 30, None, "", "123 !?"])
    assert lang[:2] == ["aa", "bb"] and not bad[:2].any() and bad[2:].all() and lang[3:] == ["und"] * 3 and (score[3:] == 0).all()
    count, _ = L.counts([rows[0][1]])
    cos = (L.vectors(count, m.idf) @ m.centroids.T)[0]
    assert abs(score[0] - cos.max()) < 1e-6 and m.langs[int(cos.argmax())] == "aa"


def test_edge_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "...", None), (4, "plain words here", "en"), (4, "plain words here", "en"), (None, "más palabras aquí", "es"), (7, "long " * 80_000, "en")]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    model = L.fit(docs)
    got = L.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert by == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "es"), (7, "en")}
    none = L.fit(docs.limit(0))
    assert {r.lang_pred for r in L.identify(docs, none).collect()} == {"und"} and L.identify(docs.limit(0), model).count() == 0


def test_copies_dont_thin_the_sample(spark):
    words = "lorem ipsum dolor amet sit elit nunc".split()
    texts = [" ".join(words[(k * j + j * j) % 7] + str(k) for j in range(40)) for k in range(60)]
    train = spark.createDataFrame([(t, "aa") for t in texts] * 200, "text string, lang string")
    m = L.fit(train, clusters=2, sample=20)
    # 2 * 20 of 12,000 rows would be less than one of the 60 texts
    assert set(m.langs) == {"aa"} and m.floor["aa"].max() > 0
    lang, score, bad = m.predict([texts[0], "ччч щщщ ъъъ ыыы " * 30])
    assert not bad[0] and bad[1]
