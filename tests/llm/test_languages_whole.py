"""Language identification: any label values, every language kept, one word pattern."""

import math
import re
import unicodedata
from collections import Counter

import pytest

from tests.llm.conftest import SF
from veilmark.llm.language_id import ORDER, held_out, identify, train

SCHEMA = "doc_id long, text string, lang string, word string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, x, "w") for k, (t, x) in enumerate(rows)], SCHEMA)


def test_labels_are_values(spark):
    """Labels that differ by case, are named like columns or hold a backtick."""
    labels = ["en", "EN", "word", "gram", "n", "lang", "a`b", "a.b", "", " "]
    rows = [(f"{chr(97 + k) * 3}x{chr(97 + k) * 4} {chr(97 + k) * 5}", x) for k, x in enumerate(labels)]
    model = train(frame(spark, rows * 3))
    assert model.languages == sorted(labels)
    assert [model.predict(t)[0] for t, _ in rows] == labels


def test_a_small_language_beside_a_large_one(spark):
    large = [(f"the number {k} of many words here w{k}x", "en") for k in range(4000)]
    small = [("see on üks eesti lause", "et"), ("tere tulemast koju", "et")]
    model = train(frame(spark, large + small), sample_docs=50, words=40, grams=200)
    assert model.languages == ["en", "et"]
    assert model.predict("üks eesti lause")[0] == "et" and model.predict("many words")[0] == "en"


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_combining_marks_stay_in_words(spark, form):
    hindi, german = "हिन्दी में लिखा हुआ वाक्य", unicodedata.normalize(form, "über die Brücke läuft")
    model = train(frame(spark, [(hindi, "hi"), (german, "de")]))
    for text in (hindi, german):
        assert set(text.lower().split()) <= set(model.words)
    assert model.predict("हिन्दी")[0] == "hi" and model.predict(german)[0] == "de"


def test_model_against_plain_python(spark):
    """The same frequencies and predictions from dictionaries, on the smallest table."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = table.where(~held_out())
    model = train(docs)
    texts = {(r.lang, r.text) for r in docs.select("lang", "text").collect() if r.lang and r.text}
    words, grams = Counter(), Counter()
    for lang, text in texts:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            words[lang, word] += 1
    for (lang, word), n in words.items():
        marked = f" {word} "
        for size in range(1, ORDER + 1):
            for k in range(len(marked) - size + 1):
                if marked[k : k + size] != " ":
                    grams[lang, marked[k : k + size]] += n
    languages = sorted({x for x, _ in texts})
    assert model.languages == languages

    def logs(counts, most):
        total = Counter()
        for (lang, _), n in counts.items():
            total[lang] += n
        keep = set()
        for lang in languages:
            mine = sorted((-n, k) for (x, k), n in counts.items() if x == lang)
            keep |= {k for _, k in mine[: most // len(languages)]}
        return {
            k: [math.log((counts[x, k] + 0.1) / (total[x] + 0.1 * most)) for x in languages] for k in keep
        }

    known, parts = logs(words, 50_000), logs(grams, 100_000)
    assert set(known) == set(model.words) and set(parts) == set(model.grams)

    def row(word):
        if word in known:
            return known[word]
        for size in range(ORDER, 0, -1):
            marked = f" {word} "
            rows = [parts[g] for k in range(len(marked) - size + 1) if (g := marked[k : k + size]) in parts]
            if rows:
                return [sum(c) / len(rows) for c in zip(*rows)]
        return [0.0] * len(languages)

    for r in identify(table, model, "doc_id", "text").collect():
        found = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        if not found:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sums = [sum(c) / math.sqrt(len(found)) for c in zip(*map(row, found))]
        weights = [math.exp(x - max(sums)) for x in sums]
        assert r.lang_pred == languages[weights.index(max(weights))]
        assert math.isclose(r.score, max(weights) / sum(weights), rel_tol=1e-3)
