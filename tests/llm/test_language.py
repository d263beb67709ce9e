import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reconcile.llm import language
from reconcile.llm.queries import op2_language
from tests.llm.cases import SF_DIR, as_dicts, awkward, documents, nothing


def _slow_bits(model, language_at, text):
    """The code length byte by byte, from counts in dictionaries."""
    table = language._code_lengths(model)
    symbol = table.symbol
    counts = {}
    for lang, gram, n in zip(model.language, model.gram, model.count, strict=True):
        if lang == language_at:
            s = [symbol[(int(gram) >> (8 * b)) & 255] for b in (3, 2, 1, 0)]
            for order in range(4):
                ctx = tuple(s[3 - order : 3])
                own = counts.setdefault(ctx, {})
                own[s[3]] = own.get(s[3], 0) + n
    used = len(set(symbol.tolist()) - {0})
    size = {x: 1 / 256 for x in range(1, used + 1)} | {0: (256 - used) / 256}

    def chances(ctx):
        shorter = chances(ctx[1:]) if ctx else size
        own = counts.get(ctx)
        if not own:
            return shorter
        total, distinct = sum(own.values()), len(own)
        rest = sum(p for s, p in shorter.items() if s not in own)
        escape = distinct if rest > 0 else 0
        return {
            s: own[s] / (total + escape) if s in own else p / rest * escape / (total + escape)
            for s, p in shorter.items()
        }

    stream = [symbol[32]] * 3 + [symbol[language.bytes_of._LOWER[b]] for b in text.encode()]
    bits = 0.0
    for i in range(3, len(stream)):
        bits -= math.log2(chances(tuple(stream[i - 3 : i]))[stream[i]])
        bits += math.log2(256 - used) if stream[i] == 0 else 0
    return bits


def test_code_lengths_are_exact(spark):
    rows = [("the cat and the hat", "en"), ("le chat et le chapeau", "fr"), (None, "en"), ("x", None), ("", "de")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["en", "fr"]
    texts = ["the chat", "zebra é", "a"]
    got = language._text_bits(language._code_lengths(model), pa.array(texts, pa.large_string()))
    expected = [[_slow_bits(model, i, t) for i in range(2)] for t in texts]
    assert np.allclose(got, expected, rtol=1e-4)


def test_chances_add_up(spark):
    model = language.fit(spark.createDataFrame([("abc abd abe", "en")], "text string, lang string"))
    bits = language._code_lengths(model).bits.reshape(-1, language.SYMBOLS)
    used = len(np.unique(model.gram & 255))
    bits[:, 0] -= np.log2(256 - used)
    assert np.allclose(np.exp2(-bits[:, : used + 1]).sum(1), 1, atol=1e-4)


def test_awkward_rows(spark):
    docs = awkward(spark)
    model = language.fit(docs)
    got = language.predict(docs, model)
    assert set(docs.columns) < set(got.columns)
    rows = as_dicts(got)
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") != letters
        assert 0 <= r["score"] <= 1
    assert language.predict(nothing(spark), model).count() == 0
    unlearned = language.fit(nothing(spark))
    assert {r["lang_pred"] for r in as_dicts(language.predict(docs, unlearned))} == {"und"}


def test_held_out_accuracy(spark):
    truth = {d["doc_id"]: d["lang"] for d in documents()}
    held = [r for r in as_dicts(op2_language(spark, SF_DIR)) if r["held_out"] and r["lang_pred"] != "und"]
    assert held
    right = sum(truth[r["doc_id"]] == r["lang_pred"] for r in held)
    assert right >= 0.95 * len(held)


def test_inputs_of_a_prediction(spark):
    """The language, source and id of a document change nothing in its prediction."""
    docs = awkward(spark)
    model = language.fit(docs)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.lit(7))
    a = sorted((r["text"] or "", r["lang_pred"], r["score"]) for r in as_dicts(language.predict(docs, model)))
    b = sorted((r["text"] or "", r["lang_pred"], r["score"]) for r in as_dicts(language.predict(other, model)))
    assert a == b


def test_rare_languages_beside_a_million_sequences(spark):
    """No count is dropped: two languages with a few words each, beside one of very many sequences."""
    text = F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 512)))
    hot = spark.range(80_000).select(text.alias("text"), F.lit("hot").alias("lang"))
    rare = [("kissa istuu ikkunalla", "fi"), ("kot siedzi w oknie", "pl")]
    model = language.fit(hot.unionByName(spark.createDataFrame(rare, "text string, lang string")))
    assert sum(model.sizes) > 1_000_000 and model.languages == ["fi", "hot", "pl"]
    docs = spark.createDataFrame([(t[4:],) for t, _ in rare], "text string")
    got = {r["text"]: r["lang_pred"] for r in as_dicts(language.predict(docs, model))}
    assert got == {t[4:]: lang for t, lang in rare}
    # Fetched one language at a time, the rows are the same.
    assert [len(gram) for gram, _ in model.by_language(fetched=1)] == model.sizes


def test_languages_of_one_script_beside_a_hot_latin_one(spark):
    """Bytes of another script are told apart, however many bytes the Latin texts have."""
    latin = "".join(map(chr, range(33, 127))) + " the cat and the hat" * 20
    ru = "съешь ещё этих мягких французских булок да выпей чаю пока он горячий и сладкий"
    uk = "щастям б'єш жук її глицю в фон й ґедзь пріч як знайшли її чаювати пізно ввечері"
    rows = [(latin, "en")] * 200 + [(ru, "ru"), (uk, "uk")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    used = set((latin.lower() + ru + uk).encode())
    assert set(np.flatnonzero(language._code_lengths(model).symbol)) == used and len(used) > 63
    docs = spark.createDataFrame([(ru[40:],), (uk[40:],)], "text string")
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in as_dicts(language.predict(docs, model))}
    assert got[ru[40:]][0] == "ru" and got[uk[40:]][0] == "uk"
    assert min(score for _, score in got.values()) > 0.999
