"""Dictionaries see whole documents, all of them, and every language."""

import re

import zstandard
from pyspark.sql import functions as F

from tallyweave.llm import language


def name(k):
    return "".join("abcdefghij"[int(c)] for c in f"{k:05d}")


def test_bodies_and_all_drawn_documents_are_in_the_dictionary(spark):
    banner = "this same opening stands before each document of the source " * 20
    rows = [(k, banner + f"{name(k)} " * 400, "xx") for k in range(200)] + [(1000 + k, f"{name(k)} " * 300, "yy") for k in range(200)]
    made = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    for lang in ("xx", "yy"):
        assert len(made[lang]) <= language.DICTIONARY_BYTES
        assert all(f" {name(k)} ".encode() in made[lang] for k in range(200))


def test_every_language_has_a_dictionary(spark):
    rows = [(k, f"words of language {name(k)}", f"l{k}") for k in range(230)]
    assert len(language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))) == 230


def test_sizes_are_those_of_a_plain_compressor_and_ties_are_rejected(spark):
    """Every language's size, with more languages than a task holds ready at a time."""
    rows = [(k, " ".join(f"{name(k * 7 + j)} {name(j)}" for j in range(30)), f"l{k:03d}") for k in range(250)]
    made = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    made["twin"] = made["l003"]
    texts = [rows[3][1], rows[77][1].upper(), rows[249][1] * 800, "x", None, " 1 "] + [rows[100][1]] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in language.identify(docs, made).collect()}
    coders = {}
    for lang, raw in made.items():
        coders[lang] = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
    for k in (0, 1, 2, 3, 6):
        data = re.sub(r"[\W\d_]+", " ", texts[k].lower()).encode()
        sizes = {n: sum(len(c.compress(data[a : a + language.BLOCK])) for a in range(0, len(data), language.BLOCK)) for n, c in coders.items()}
        least = min(sizes.values())
        assert got[k].lang_pred == next(n for n, v in sizes.items() if v == least)
        if sum(v == least for v in sizes.values()) > 1:
            assert got[k].lang_rejected and got[k].lang_score == 0
    assert (got[0].lang_pred, got[1].lang_pred, got[2].lang_pred) == ("l003", "l077", "l249") and got[0].lang_rejected
    assert got[4].lang_pred == got[5].lang_pred == "und" and got[6].lang_pred == got[7].lang_pred == "l100"


def test_shares():
    assert language.level([5, 100, 100], 105) == 50 and language.level([3, 4], 100) == 4 and language.level([], 9) == 0
