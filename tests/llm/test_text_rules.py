"""License scans and quality rules against plain versions."""

import os
import random
import re

import pytest

from tallyweave.llm import licenses, quality

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_licenses(text):
    words, at, labels = WORD.findall(lower(text)), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted(labels)


TEXTS = [
    None, "", "Released under the MIT License.", "Licensed under CC BY-NC 4.0. cc by cc BY", "mit license mit license", "the Apache\nLicense, apache  license",
    "This work is licensed under the GNU General Public License, version 3.", "gnu general public", "a mit licenses b", "Licensed under the Apache License, Version 2.0 (the \"License\"); x",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software " * 3, "été MIT license 日本 cc by",
]


def test_base_places(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id bigint, text string, n_words string")
    for r in licenses.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(TEXTS[r.doc_id])
        assert set(r.base_labels) <= set(r.license_labels) and 0 <= r.license_score <= 1
        assert bool(r.license_labels) == (r.license_score > 0)


@pytest.mark.parametrize(
    "text, accepted",
    [
        ("use is granted to Ann by law", True), ("use is kindly granted to Ann Lee of Rome by law", True), ("use is granted by law", True), ("use is granted to a b c d e by law", False),
        ("use is not granted to Ann by law", False), ("xx use is granted to Ann by law yy", True), ("use is granted to Ann by", False),
    ],
)
def test_template_regions(text, accepted):
    template = "Use is <<beginOptional>>kindly<<endOptional>> granted <<beginOptional>>to <<var;most=4>><<endOptional>> by law."
    found = licenses.Scanner({}, {"t": template}).scan(text.encode())
    assert (found[5] == ["t"]) is accepted


def labels_and_spans(text, templates=None):
    found = licenses.Scanner(licenses.PHRASES, templates or licenses.TEMPLATES).scan(text.encode())
    return [(s["label"], s["start"], s["end"]) for s in found[7]]


def test_longest_stretch_and_the_more_specific_template():
    assert labels_and_spans("x Licensed under CC BY-NC-SA 4.0 License y") == [("cc-by-nc-sa-notice", 1, 10)]
    assert labels_and_spans("CC BY 4.0") == [("cc-by-notice", 0, 4)] and labels_and_spans("cc by nc") == [("cc-by-nc-notice", 0, 3)]
    assert labels_and_spans('Licensed under the Apache License, Version 2.0 (the "License") x') == [("apache-2.0-notice", 0, 10)]
    trailing = {"t": "stop <<beginOptional>>here <<var;most=2>> now<<endOptional>>"}
    assert labels_and_spans("stop here a b now", trailing) == [("t", 0, 5)] and labels_and_spans("stop here a b c now", trailing) == [("t", 0, 1)]
    assert labels_and_spans("stop stop here now stop", trailing) == [("t", 0, 1), ("t", 1, 4), ("t", 4, 5)]
    assert labels_and_spans("a b c", {"u": "a b", "v": "a b", "w": "b c"}) == [("u", 0, 2), ("v", 0, 2), ("w", 1, 3)]


@pytest.mark.parametrize("label", ["mit", "bsd-2-clause", "bsd-3-clause", "isc", "apache-2.0-header"])
def test_whole_license_texts(label):
    """A whole text, with names in its replaceable regions, once more with one mandatory word changed."""
    plain = re.sub(r"<<(?:begin|end)Optional>>", "", licenses.TEMPLATES[label])
    text = re.sub(r"<<var;most=1>>", "2.", plain)
    text = re.sub(r"<<var;most=\d+>>", "Ann Lee AND CO", text)
    words = len(WORD.findall(lower(text)))
    assert labels_and_spans(f"Copyright 2001\n{text}\nint main;") == [(label, 2, words + 2)]
    changed = re.sub("(?i)(warranties|conditions|permission)", "promises", text, count=1)
    assert label not in [x for x, *_ in labels_and_spans(changed)]


def test_faulty_templates():
    for template in ("<<beginOptional>>a", "a<<endOptional>>", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.Automaton(template)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k : k + 8]), []).append(k)
    repeated = {w for at in places.values() if len(at) > 1 for k in at for w in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_counts_equal_plain_ones(spark):
    rng = random.Random(4)
    words = ["a", "B", "été", "d$", "e|f", "日本"]
    texts = [None, "", " \n\t", "x" * 5000, "a b c d e f g h " * 3, "one two three four five six seven eight", "é " * 30 + "\n\n" + "line\nline\n line\n"]
    texts += [" ".join(rng.choice(words[: rng.choice([2, 6])]) + rng.choice(["", "", "\n", "\x0b"]) for _ in range(rng.choice([3, 20, 90]))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, "en", None, True) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, kept boolean")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert tuple(r[c] for c in quality.COUNTS) == plain_counts(t), t
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_thresholds_adapt_to_the_group(spark):
    rng = random.Random(5)
    text = lambda n, mark: " ".join(f"{rng.choice('abcdefghij')}{rng.randint(0, 999)}{mark}" for _ in range(n))
    rows = [(k, text(60, ""), "en", "prose") for k in range(200)] + [(1000 + k, text(60, "|||"), "en", "tables") for k in range(200)]
    rows += [(2000, text(60, "$$$"), "en", "prose"), (2001, text(60, "$$$"), "en", "tables"), (2002, text(60, ""), None, None)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not kept[2000] and kept[2001] and kept[2002] and sum(kept.values()) == len(rows) - 1


def test_quality_labels(spark):
    """Recall of poor documents and loss of good ones, and whether fences follow the sketch."""
    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")
    if not os.path.isdir(data):
        pytest.skip("needs the stored tables")
    judged = quality.judge(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source"))
    rows = judged.join(spark.read.parquet(f"{data}/labels.parquet").where("quality is not null"), "doc_id").select("quality", "base_failed", "kept").collect()
    poor, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in poor) >= 0.9 * len(poor) and sum(r.kept for r in good) >= 0.98 * len(good)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert quality.judge(docs).collect() == [] and licenses.scan(docs).collect() == []


def test_one_outlier_moves_no_fence(spark):
    rng = random.Random(5)
    text = lambda: " ".join(f"plain{rng.randint(0, 999)}" for _ in range(120))
    rows = [("en", "big", f"{text()} #" if k % 9 == 0 else text()) for k in range(400)] + [("en", "small", text()) for _ in range(2)]
    table = lambda more: spark.createDataFrame([(k, *r) for k, r in enumerate(rows + more)], "doc_id bigint, lang string, source string, text string")
    outlier = ("en", "small", f"{text()} " + " ".join(f"#${k}%" for k in range(200)))

    def fences(docs):
        measured = quality.counts(docs).withColumns(quality._measures())
        return {r.source: r.most_symbol_rate for r in quality.thresholds(measured).collect()}

    before, after = fences(table([])), fences(table([outlier]))
    assert abs(after["small"] - before["small"]) <= 1 and after["big"] == before["big"]
    kept = {r.doc_id: r.kept for r in quality.judge(table([outlier])).collect()}
    assert not kept.pop(402) and all(kept.values())
