import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from corpuslens.llm import language_id as L
from corpuslens.llm import queries as Q


def brute_path(scores, prior, penalty):
    best = None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        v = prior[path[0]] + sum(scores[t, s] for t, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        if best is None or v > best[0] + 1e-9:
            best = (v, path)
    return best


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([5, 0, 1, 6, 3])
    scores = rng.normal(size=(15, 3)).astype(np.float32) * 3
    prior = np.log([0.5, 0.3, 0.2])
    got = L.viterbi(scores, lengths, prior, 2.0)
    at = 0
    for n in lengths:
        s, mine, at = scores[at:at + n], got[at:at + n], at + n
        if n:
            v = prior[mine[0]] + sum(s[t, k] for t, k in enumerate(mine)) - 2.0 * sum(a != b for a, b in zip(mine, mine[1:]))
            assert abs(v - brute_path(s, prior, 2.0)[0]) < 1e-4
    assert len(L.viterbi(np.zeros((0, 3), np.float32), np.array([0]), prior, 1.0)) == 0


def test_words_and_scripts():
    w = L.words_of("Ünder, 12 привет_x 漢字 é")
    assert list(zip(w.start.tolist(), w.end.tolist(), w.script.tolist())) == [(0, 5, 1), (10, 16, 3), (17, 18, 1), (19, 21, 14), (22, 23, 1)]
    assert (L.words_of("ÜNDER").grams == L.words_of("ünder").grams).all() and len(L.words_of("").start) == 0


def corpus(rng):
    words = {"aa": ["lorm", "dalor", "sitam", "konsek"], "bb": ["wysho", "przek", "chwila", "szyb"], "ru": ["привет", "мир", "снова"]}
    make = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    return make, [(i, make(x, 30), x) for i, x in enumerate(["aa", "bb", "ru"] * 40)]


def test_spans_of_mixed_text_and_hard_rows(spark):
    rng = random.Random(4)
    make, rows = corpus(rng)
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "12 34 !", None), (None, make("aa", 5), None), (7, rows[7][1], "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    m = L.fit(df, F.lit(True))
    assert m.languages == ["aa", "bb", "ru"]
    a, b, c = make("aa", 8), make("bb", 8), make("ru", 3)
    (lang, score, spans), = L.label(m, [f"{a}. {b} -- {c}"])
    assert [s[2] for s in spans] == ["aa", "bb", "ru"] and spans[1] == (len(a) + 2, len(a) + 2 + len(b), "bb")
    assert L.label(m, ["漢字漢"])[0][:2] == (m.languages[int(m.prior.argmax())], 0.0)
    out = L.identify(df, m).collect()
    assert len(out) == len(rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id in (200, 201, 202))
    assert all(r.lang_pred == rows[r.doc_id][2] and 0 <= r.score <= 1 for r in out if r.doc_id is not None and r.doc_id < 120)
    long = L.label(m, [make("bb", 60_000)])[0]
    assert long[0] == "bb" and len(long[2]) == 1
    assert L.fit(df.limit(0), F.lit(True)) is None and [r.lang_pred for r in L.identify(df.limit(2), None).collect()] == ["und"] * 2
    assert L.identify(df.limit(0), m).count() == 0


def test_held_out_accuracy(spark, sf):
    out = Q.QUERIES["op6_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_words_end_where_the_script_changes():
    def places(t):
        w = L.words_of(t)
        return [(t[a:b], k) for a, b, k in zip(w.start.tolist(), w.end.tolist(), w.script.tolist())]

    assert places("使用python编程") == [("使用", 14), ("python", 1), ("编程", 14)]
    assert places("हिन्दी ภาษาไทย தமிழ்") == [("हिन्दी", 7), ("ภาษาไทย", 10), ("தமிழ்", 9)]
    assert places("é x́y oʼneil ́a ́") == [("é", 1), ("x́y", 1), ("oʼneil", 1), ("a", 1)]
    assert [k for _, k in places("తెలుగు ಕನ್ನಡ മലയാളം ગુજરાતી ਪੰਜਾਬੀ ខ្មែរ ລາວ မြန်မာ አማርኛ ﾊﾝ ＡＢ")] == [17, 18, 19, 16, 15, 24, 21, 22, 23, 13, 1]
    same = L.words_of("编程 python")
    mixed = L.words_of("编程python")
    assert same.grams.tolist() == mixed.grams.tolist()  # a cut is an edge like any other


def test_mixed_script_text_has_a_span_for_each_language(spark):
    train = [(k, "the quick brown fox and the lazy dog", "en") for k in range(9)] + [(k, "编程语言是一种被标准化的交流技巧", "zh") for k in range(9, 18)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = L.fit(docs, F.lit(True), switch_penalty=1.0)
    assert [x[2] for x in L.label(model, ["brown编程语言是一种the lazy dog"])[0][2]] == ["en", "zh", "en"]


def test_null_ids_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(None, f"word{k} more words here", "en") for k in range(400)], "doc_id long, text string, lang string")
    model = L.fit(docs, F.lit(True), rows_per_language=100)
    assert model is not None and model.languages == ["en"]


def test_word_scores_equal_sums_of_trigram_log_probabilities():
    rng = np.random.default_rng(2)
    m = L.Model(["a", "b"], rng.normal(size=(L.BUCKETS, 2)).astype(np.float32), np.ones((L.SCRIPTS, 2), bool), np.zeros(2), 1.0)
    text = "Mixed words, с кириллицей 漢字x é"
    w = L.words_of(text)
    got = L.word_scores(m, w)
    for k, (a, b) in enumerate(zip(w.start, w.end)):
        alone = L.words_of(text[a:b])  # a word's trigrams do not depend on its neighbours
        assert np.allclose(got[k], m.log_p[alone.grams].sum(axis=0), atol=1e-4)
