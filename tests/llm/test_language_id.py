import random

from pyspark.sql import functions as F

from dialoom.llm import language_id

SYLLABLES = {"aa": "ka ki ku ta to na ne", "bb": "schei ber gen und der lich", "cc": "oui eau eux ment tion"}


def corpus(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        lang = draw.choice(list(SYLLABLES))
        words = ["".join(draw.choice(SYLLABLES[lang].split()) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(3, 80))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.createDataFrame(corpus(400, 1), "doc_id long, text string, lang string")
    model = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs, model).withColumn("held", language_id.held_out(F.col("doc_id")))
    rows = found.filter("held").collect()
    assert len(rows) > 50 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert not any(r.rejected for r in rows) and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, "ржавый ключ открывает дверь медленно и громко")], "doc_id long, text string")
    assert language_id.identify(odd, model).first().rejected


def test_edges(spark):
    rows = corpus(60, 2) + [(100, None, "aa"), (101, "", "aa"), (102, "123 ... 456", "bb"), (103, "ka ki ku", None), (None, "ka ki to", "aa"), (104, "oui eau " * 50_000, "cc")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    model = language_id.learn(docs)
    out = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for d in (100, 101, 102):
        assert out[d].lang_pred == "und" and out[d].score == 0 and out[d].rejected
    assert out[103].lang_pred == "aa" and out[104].lang_pred == "cc" and out[None].lang_pred == "aa"
    nothing = language_id.learn(docs.filter("lang = 'none'"))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_clusters_are_used():
    rows = language_id._unit(language_id.np.eye(6, language_id.DIMENSIONS)[[0, 0, 1, 1, 2, 2]])
    assert len(language_id._cluster(rows, 3)) == 3


def words(syllables, letters, draw):
    out, n = [], 0
    while n < letters:
        out.append("".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))))
        n += len(out[-1])
    return " ".join(out)


def test_a_language_left_out_is_rejected_at_every_length(spark):
    draw = random.Random(5)
    tongues = {**{k: v.split() for k, v in SYLLABLES.items()}, "dd": "mor vel sta zin pra lo gu wi".split()}

    def noise(letters):  # each row of junk in an alphabet of its own
        first = draw.randrange(0x4E00, 0x9000)
        return "".join(chr(first + draw.randrange(40)) for _ in range(letters))

    for left in tongues:
        rows = []
        for lang in tongues.keys() - {left}:
            for c in range(4, 11):  # no training text is longer than 2 ** 11 letters, but one of junk
                rows += [(words(tongues[lang], 1.2 * 2**c, draw), lang) for _ in range(12)]
            rows += [(noise(draw.choice((40, 100, 300))), lang) for _ in range(7)]
            rows.append((noise(9000), lang))
        model = language_id.learn(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string"))
        for c in range(5, 16):
            for lang in tongues:
                texts = [words(tongues[lang], 1.2 * 2**c, draw) for _ in range(10 if c < 11 else 3)]
                names, _, rejected = model.classify(texts)
                if lang == left:
                    assert rejected.all(), (left, c)
                else:
                    assert not rejected.any() and {*names} == {lang}, (left, lang, c)


def test_junk_does_not_move_the_limits(spark):
    draw = random.Random(6)
    good = [(i, words(SYLLABLES["bb"].split(), draw.choice((200, 500)), draw), "bb") for i in range(186)]
    junk = [(1000 + i, "".join(draw.choices("qwxyz jkvpf 0123 #", k=draw.choice((300, 800)))), "bb") for i in range(14)]
    clean, mixed = (language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")) for rows in (good, good + junk))
    assert (mixed.limits[0, 5:] > 0.8 * clean.limits[0, 5:]).all()


def test_a_language_without_letters(spark):
    docs = spark.createDataFrame(corpus(60, 2) + [(200 + i, "12345 678", "digits") for i in range(9)], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert model.names == ["aa", "bb", "cc"]
    assert {r.lang_pred for r in language_id.identify(docs.filter("lang = 'digits'"), model).collect()} == {"und"}
    only = language_id.learn(docs.filter("lang = 'digits'"))
    assert {r.lang_pred for r in language_id.identify(docs, only).collect()} == {"und"}
