import zlib

from pyspark.sql import functions as F

from tarnwright.llm import language_id as op

WORDS = {"en": "the house and the river with other things that were there when they thought", "de": "das Haus und der Fluss mit anderen Dingen die dort waren als sie nicht dachten", "fr": "la maison et la rivière avec les autres choses qui étaient là quand ils pensaient"}


def test_ranked_by_count_and_code():
    codes, counts = op.grams("ab ab 1 c")
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True))[ord("a")] == 2
    top = op.ranked("ab ab 1 c", 3)
    assert (top[:2] == sorted([ord("a"), ord("b")])).all()
    assert len(op.ranked("1 2 !")) == 0


def test_identify(spark):
    rows = []
    for i in range(300):
        lang = [*WORDS][i % 3]
        w = WORDS[lang].split()
        rows.append((i, " ".join(w[(i * k) % len(w)] for k in range(1, 30)).upper() if i % 5 == 0 else " ".join(w[i % 4 :]), lang, 1))
    odd = [(1000, None, "en", 1), (1001, "", None, 1), (1002, "12 !?", "xx", 1), (None, "the house and the river", None, 1), (5, rows[5][1], rows[5][2], 1), (1003, "the house " * 20000, "en", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")
    out = op.identify(docs).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    assert all(by[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, *_ in rows)
    assert sum(by[d].lang_pred == lang for d, _, lang, _ in rows) >= 0.99 * len(rows)
    assert all((by[d].lang_pred, by[d].score) == ("und", 0.0) for d in (1000, 1001, 1002))
    assert by[None].lang_pred == "en" and by[None].held_out is False and by[1003].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out)
    kept = op.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(out) - 3
    assert {r.lang_pred for r in op.identify(docs.filter("doc_id > 999")).collect()} <= {"und", "en", "xx"}
    assert op.identify(docs.filter("false")).count() == 0


def test_distance_against_a_plain_loop():
    learnt = {k: op.ranked(v).tolist() for k, v in WORDS.items()}
    ranks = op.Ranks(learnt)
    for text in [*WORDS.values(), "maison", "Fluss die there", "zzz"]:
        own = op.ranked(text).tolist()
        d = {k: sum(abs(i - p.index(g)) if g in p else op.PROFILE for i, g in enumerate(own)) for k, p in learnt.items()}
        best = min(sorted(d), key=d.get)
        assert ranks.predict(text) == (best, 1 - d[best] / (op.PROFILE * len(own)))


def test_accuracy_on_held_out_documents(spark):
    """Profiles come from three quarters of the labelled documents; the others are predicted, without a look at lang."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = op.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    n, right = found.agg(F.count("*"), F.count_if(F.col("lang_pred") == F.col("lang"))).first()
    assert n > 2_000 and right >= 0.99 * n


def test_ties_clashing_names_and_long_texts(spark):
    learnt = {"bb": op.ranked("same words in both").tolist(), "aa": op.ranked("same words in both").tolist()}
    assert op.Ranks(learnt).predict("same words in both")[0] == "aa"
    rows = [(i, "der und die das" if i % 2 else "the of and to", "de" if i % 2 else "en", 1, 2.0, "x") for i in range(40)]
    rows += [(100, "the of and to " * 200_000, "en", 1, 2.0, "x"), (101, None, "en", 1, 2.0, "x"), (102, "123", "en", 1, 2.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, share int, rows double, gram string")
    kept = op.with_language(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(40), 100}
    assert op.with_language(docs.filter("false")).count() == 0


def test_a_dirty_column_makes_a_bounded_model(spark):
    rows = [(i, w, lang) for i, (lang, w) in enumerate([*WORDS.items()] * 20)]
    rows += [(1000 + i, "zqx zqx", f"typo{i:04}") for i in range(1200)] + [(5000 + i, "zqx zqx", "typo0000") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = op.profiles(docs)
    assert len(learnt) == op.LANGUAGES and set(WORDS) <= set(learnt)
    assert sorted(op.profiles(docs, languages=5)) == sorted([*WORDS, "typo0000", "typo0001"])
    found = {r.doc_id: r.lang_pred for r in op.identify(docs, op.profiles(docs, languages=3)).collect()}
    assert len(found) == len(rows) and all(found[i] == lang for i, _, lang in rows[:60]) and found[1000] in WORDS
