import random

from pyspark.sql import functions as F

from strainframe.llm import language_id

SYLLABLES = {"aa": ["ka", "to", "mi", "ru", "shi", "no"], "bb": ["schl", "ung", "ich", "ver", "kei", "ten"], "cc": ["eau", "oux", "tre", "ment", "ais", "lle"]}


def texts(count, seed):
    dice = random.Random(seed)
    out = []
    for n in range(count):
        lang = list(SYLLABLES)[n % 3]
        words = ["".join(dice.choices(SYLLABLES[lang], k=dice.randint(1, 3))) for _ in range(dice.randint(6, 60))]
        out.append((n, " ".join(words), lang))
    return out


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(texts(300, 1), "doc_id long, text string, lang string")
    content = language_id.learn(docs.filter("doc_id % 4 <> 2"))
    assert sorted(content) == ["aa", "bb", "cc"]
    found = language_id.predict(docs.filter("doc_id % 4 = 2"), content)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert found.filter("lang_score < 0 or lang_score > 1").count() == 0


def test_unknown_and_narrow(spark):
    content = language_id.learn(spark.createDataFrame(texts(60, 2), "doc_id long, text string, lang string"))
    rows = [(1, None), (2, ""), (3, "12 345 !?"), (4, "kato miru shino"), (5, "KATO 1 MIRU, shino!!"), (6, "q"), (7, "kato " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit("old")).withColumn("Lang_Score", F.lit(9))
    found = {r["doc_id"]: r for r in language_id.predict(docs, content).withColumn("ok", language_id.accepted()).collect()}
    assert [found[n]["lang_pred"] for n in (1, 2, 3)] == ["und"] * 3 and not any(found[n]["ok"] for n in (1, 2, 3))
    assert all(found[n]["lang_pred"] == "aa" and found[n]["ok"] for n in (4, 5, 7))
    assert not found[6]["ok"]  # every dictionary says the same


def test_nothing_learned(spark, awkward):
    assert language_id.learn(awkward.withColumn("lang", F.lit(None).cast("string"))) == {}
    found = language_id.predict(awkward, {})
    assert found.count() == awkward.count() and found.filter("lang_pred <> 'und' or lang_score <> 0").count() == 0
    assert language_id.predict(awkward.limit(0), language_id.learn(awkward)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(awkward, language_id.learn(awkward)).collect()} == {"en", "und"}


def test_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.lit(1).alias("id"), F.lit("aa").alias("lang"), F.lit("some text").alias("text"))
    assert language_id.sample(docs, {"aa": 3000}, 2000, 5).count() <= 2000
    spread = spark.range(3000).select("id", F.lit("aa").alias("lang"), F.lit("some text").alias("text"))
    assert language_id.sample(spread, {"aa": 3000}, 50, 5).count() == 50


def plain_prediction(text, content):
    """One-shot compression of every block with every dictionary, sizes compared in a plain loop."""
    import zstandard

    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    plain = language_id.letters(text)
    while len(plain) < language_id.SHORT_BYTES:
        plain += language_id.letters(text)
    sizes = {}
    for lang, known in content.items():
        total = 0
        for at in range(0, len(plain), language_id.BLOCK_BYTES):
            settings = zstandard.ZstdCompressionParameters(
                window_log=20, min_match=3, target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False, **language_id.FINDER
            )
            words = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=settings)
            total += len(zstandard.ZstdCompressor(dict_data=words, compression_params=settings).compress(plain[at : at + language_id.BLOCK_BYTES]))
        sizes[lang] = total
    best = min(sorted(sizes), key=sizes.get)
    return best, 1 / sum(2 ** (language_id.BITS_PER_BYTE * (sizes[best] - size)) for size in sizes.values())


def test_equals_a_plain_loop_in_any_blocks(spark):
    docs = spark.createDataFrame([*texts(60, 5), (90, None, "aa"), (91, "12", "aa"), (92, "kato miru " * 3000, "aa"), (93, "q", "bb")], "doc_id long, text string, lang string")
    content = language_id.learn(docs)
    expected = {r["doc_id"]: plain_prediction(r["text"], content) for r in docs.collect()}
    for block in (1, 2, 100):
        found = {r["doc_id"]: r for r in language_id.predict(docs, content, block_languages=block).collect()}
        assert {n: r["lang_pred"] for n, r in found.items()} == {n: lang for n, (lang, _) in expected.items()}
        assert all(abs(found[n]["lang_score"] - score) < 1e-9 for n, (_, score) in expected.items())
        assert found[90]["lang_margin"] == 0 and found[92]["lang_margin"] > 0.1


def test_more_languages_than_a_block(spark):
    dice = random.Random(8)
    stems = [["".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6)] for _ in range(150)]
    rows = [(n, " ".join(dice.choices(stems[n % 150], k=12)), f"l{n % 150:03d}") for n in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = language_id.learn(docs.filter("doc_id < 750"))
    assert len(content) == 150
    found = language_id.predict(docs.filter("doc_id >= 750"), content).collect()
    assert len(found) == 150 and all(r["lang_pred"] == r["lang"] for r in found)


def test_rows_without_text_and_repeated_rows_take_no_share(spark):
    mostly_empty = spark.range(20_000).selectExpr("id as doc_id", "case when id % 5000 = 0 then concat('kato miru shino ', id) end as text", "'aa' as lang")
    repeated = spark.range(20_000).selectExpr("7L as doc_id", "case when id < 3 then 'schlung verkeiten' else 'ichver tenung' end as text", "'bb' as lang")
    assert sorted(language_id.learn(mostly_empty.unionByName(repeated), documents=10)) == ["aa", "bb"]
