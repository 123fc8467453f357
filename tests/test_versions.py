"""Comparison of versions against sequential programs on small cases."""

import random
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallyweave.functions import text as X
from tallyweave.operators import ordered
from tallyweave.operators import versions as V
from tallyweave.operators import windows as W


def rising(pairs):
    """The longest chain by trying all lengths: for each element the best it can follow."""
    pairs, best = sorted(pairs), []
    for k, (_, b) in enumerate(pairs):
        can = [(-best[j][0], pairs[j][1], j) for j in range(k) if pairs[j][1] < b]
        n, _, j = min(can) if can else (0, 0, None)
        best.append((1 - n, j))
    out = []
    k = min(range(len(pairs)), key=lambda k: (-best[k][0], pairs[k][1])) if pairs else None
    while k is not None:
        out.append(pairs[k])
        k = best[k][1]
    return out[::-1]


def plain_ops(a, b):
    a, b = ([(k, "".join(t.split())) for k, t in x if "".join(t.split())] for x in (a, b))
    ta, tb = [t for _, t in a], [t for _, t in b]
    pairs = rising([(k, dict((t, j) for j, t in b)[t]) for k, t in a if ta.count(t) == 1 and tb.count(t) == 1])
    bounds = [(-1, -1), *pairs, (10**9, 10**9)]
    for (a0, b0), (a1, b1) in zip(bounds, bounds[1:]):
        left, right = [x for x in a if a0 < x[0] < a1], [x for x in b if b0 < x[0] < b1]
        met, seen = [], {}
        for k, t in left:
            seen[t] = seen.get(t, 0) + 1
            same = [j for j, u in right if u == t]
            if seen[t] <= len(same):
                met.append((k, same[seen[t] - 1]))
        pairs = pairs + rising(met)
    ops, pairs = [], sorted(pairs)
    bounds = [(-1, -1), *pairs, (10**9, 10**9)]
    for (a0, b0), (a1, b1) in zip(bounds, bounds[1:]):
        if a0 >= 0:
            ops.append((0, a0, b0, dict(a)[a0]))
        ops += [(-1, k, None, t) for k, t in a if a0 < k < a1]
        ops += [(1, None, k, t) for k, t in b if b0 < k < b1]
    out, at, bt = [], 0, 0
    for n, (op, k, j, t) in enumerate(ops, 1):
        out.append((n, op, k, j, t, at, bt))
        at += len(t) * (op <= 0)
        bt += len(t) * (op >= 0)
    return out


def made_docs(seed):
    rng, docs = random.Random(seed), {}
    for d in range(25):
        a = [rng.choice(["same", "x y", " ", "", "end"]) if rng.random() < 0.4 else f"line {rng.randint(0, 40)}" for _ in range(rng.randint(0, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            if b and rng.random() < 0.6:
                t = b.pop(rng.randrange(len(b)))
                if rng.random() < 0.5:
                    b.insert(rng.randint(0, len(b)), t)
            else:
                b.insert(rng.randint(0, len(b)), rng.choice(["new", "same", f"line {rng.randint(0, 40)}"]))
        number = lambda x: [(k * step + first, t) for step, first in [(rng.randint(1, 5), rng.randint(0, 9))] for k, t in enumerate(x)]
        docs[d] = (number(a), number(b))
    return docs


def lines_of(spark, docs, side):
    return spark.createDataFrame([(d, k, t) for d, x in docs.items() for k, t in x[side]], "doc_id bigint, line_no bigint, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_offsets_equal_a_sequential_alignment(spark, seed):
    docs = made_docs(seed)
    got = {}
    for r in V.offsets(V.ordered_diff(lines_of(spark, docs, 0), lines_of(spark, docs, 1))).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append((r.place, r.op, r.a_line, r.b_line, r.text, r.offset_a, r.offset_b))
    assert got == {d: ops for d, (a, b) in docs.items() if (ops := plain_ops(a, b))}


def test_equal_numbering_and_a_moved_line(spark):
    a = [(k, f"l{k}") for k in range(10)]
    b = [(k, "x5" if k == 5 else t) for k, t in a]
    moved = [a[k] for k in (0, 1, 3, 4, 5, 6, 2, 7, 8, 9)]
    docs = {1: (a, b), 2: (a, [(k, t) for k, (_, t) in enumerate(moved)])}
    ops = V.offsets(V.ordered_diff(lines_of(spark, docs, 0), lines_of(spark, docs, 1))).where("op <> 0").orderBy("doc_id", "place").collect()
    assert [(r.doc_id, r.op, r.text, r.offset_a, r.offset_b) for r in ops] == [(1, -1, "l5", 10, 10), (1, 1, "x5", 12, 10), (2, -1, "l2", 4, 4), (2, 1, "l2", 14, 12)]


def plain_pages(a, b, least=0.3):
    """The banded program over two lists of page texts, as (a, b) places."""
    bare = lambda t: "".join(t.split())

    def score(s, t):
        if bare(s) == bare(t):
            return 1.0
        if not bare(s) or not bare(t):
            return 0.0
        s, t = set(s.split()), set(t.split())
        return len(s & t) / min(len(s), len(t))

    na, nb = len(a), len(b)
    if na == nb:
        return [(k, k) for k in range(na)]
    band = max(5, abs(na - nb) + 3)
    best, step = [[0.0] * (nb + 1) for _ in range(na + 1)], {}
    for i in range(1, na + 1):
        for j in range(max(1, i - band), min(nb, i + band) + 1):
            s = score(a[i - 1], b[j - 1])
            options = [best[i - 1][j - 1] + s if s >= least else -1.0, best[i - 1][j], best[i][j - 1]]
            best[i][j] = max(options)
            step[i, j] = options.index(max(options))
    out, i, j = [], na, nb
    while i or j:
        s = step.get((i, j), 2) if i and j else 1 if i else 2
        out.append((i - 1 if s != 2 else None, j - 1 if s != 1 else None))
        i, j = i - (s != 2), j - (s != 1)
    return out[::-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_equal_the_banded_program(spark, seed):
    rng, docs = random.Random(seed), {}
    word = lambda: rng.choice("abcdefghijkl")
    for d in range(40):
        a = [" ".join(word() for _ in range(rng.randint(0, 5))) for _ in range(rng.choice([0, 1, 4, 9, 14]))]
        b = [t if rng.random() < 0.6 else " ".join(word() for _ in range(4)) for t in a if rng.random() < 0.8]
        for _ in range(rng.choice([0, 1, 2, 9])):
            b.insert(rng.randint(0, len(b)), word())
        docs[d] = (a, b)
    table = lambda s: spark.createDataFrame([(d, 10 * k + 3, t) for d, x in docs.items() for k, t in enumerate(x[s])], "doc_id bigint, page bigint, text string")
    got = {}
    for r in V.align_pages(table(0), table(1)).collect():
        place = lambda p: None if p is None else (p - 3) // 10
        got.setdefault(r.doc_id, set()).add((place(r.a_page), place(r.b_page)))
        if r.a_page is not None and r.b_page is not None:
            same = "".join(docs[r.doc_id][0][place(r.a_page)].split()) == "".join(docs[r.doc_id][1][place(r.b_page)].split())
            assert r.diff_type == ("equal" if same else "modified")
        else:
            assert r.diff_type == ("added" if r.a_page is None else "deleted")
    assert got == {d: set(plain_pages(a, b)) for d, (a, b) in docs.items() if a or b}


def test_alike_pairs_miss_none_and_leave_most_out(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([1, 2, 5, 9, 14])))
    left = [(d, k, word()) for d in range(3) for k in range(40)] + [(0, 40, "")]
    right = [(d, k, t if rng.random() < 0.2 else t[1:] + rng.choice("xyz") if rng.random() < 0.3 else word()) for d, k, t in left for k in (k, k + 100)]
    frame = lambda rows, own: spark.createDataFrame(rows, f"doc_id bigint, {own} bigint, key string")
    found = {tuple(r) for r in V.alike_pairs(frame(left, "l"), frame(right, "r"), ["doc_id"], 0.8).collect()}
    for d, l, a in left:
        for e, r, b in right:
            alike = a and b and (len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) or a in b or b in a)
            assert not (d == e and alike) or (d, l, r) in found
    assert len(found) < 0.3 * sum(d == e for d, _, _ in left for e, _, _ in right)


def test_anchor_windows_by_hand(spark):
    lines = spark.createDataFrame([(1, n, t) for n, t in enumerate(["一 总 则", " ", "适用，范围", "定义", "附则", "适用范围定义x", "总则"])], "doc_id bigint, line_no bigint, text string")
    anchors = spark.createDataFrame([(1, 1, 2, "适用,范围\n定义"), (1, 2, 1, "总则"), (1, 3, 1, "不在这里的一行"), (1, 4, 1, " "), (2, 1, 1, "总则")], "doc_id bigint, anchor bigint, k int, text string")
    got = {(r.anchor, r.line_no, r.width, r.score) for r in V.anchor_windows(lines, anchors).collect()}
    assert got == {(1, 2, 2, 1.0), (2, 6, 1, 1.0)}


def test_waiting_labels_equal_a_queue(spark):
    rng, rows, expected = random.Random(7), [], set()
    for d in range(30):
        waiting = []
        for n in range(40):
            text = rng.choice(["12", "3,4", "name", "label", "no 5"]) if d % 2 else rng.choice(["12", "7.5", "name"])
            rows.append((d, n, text))
            if text == "no 5":
                waiting.clear()
            elif text[0].isdigit():
                if waiting:
                    expected.add((d, waiting.pop(0), n))
            else:
                waiting.append(n)
    frame = spark.createDataFrame(rows, "doc_id bigint, line_no bigint, text string")
    assert {tuple(r) for r in ordered.number_labels(frame).collect()} == expected


def test_pages_fill_as_a_loop_fills_them(spark):
    rng, lines, pages, expected = random.Random(8), [], [], set()
    for d in range(30):
        own = [(n * 3, "x" * rng.randint(0, 9) + " ") for n in range(rng.randint(1, 30))]
        page = [(p, "y " * rng.choice([0, 3, 8, 20])) for p in range(rng.randint(0, 8))]
        lines += [(d, n, t) for n, t in own]
        pages += [(d, p, t) for p, t in page]
        at = 0
        for p, t in page:
            held = 0
            while at < len(own) and held < t.count("y"):
                expected.add((d, own[at][0], p))
                held += own[at][1].count("x")
                at += 1
        expected |= {(d, n, None) for n, _ in own[at:]}
    schema = "doc_id bigint, {} bigint, text string"
    got = V.fill_pages(spark.createDataFrame(lines, schema.format("line_no")), spark.createDataFrame(pages, schema.format("page")))
    assert {tuple(r) for r in got.collect()} == expected


def tree(spark, rows):
    return spark.createDataFrame([(1, n, p, k, t, b) for n, p, k, t, b in rows], "doc_id bigint, line_no bigint, parent bigint, level int, title string, body string")


def test_third_title_is_held_against_the_first_of_its_group(spark):
    rows = [(0, None, 1, "Scope", "longer body"), (1, None, 1, "Scope of work", "b"), (2, 1, 2, "Child", ""), (3, None, 1, "work", "x"), (4, 3, 2, "Kept", ""), (5, None, 1, "of work", "")]
    kept = ordered.collapse_siblings(tree(spark, rows)).collect()
    # "work" is within the second title and not within the first, so it opens a group, and "of work" joins that.
    assert sorted(r.line_no for r in kept) == [1, 2, 3, 4]
    merged = ordered.collapse_siblings(tree(spark, [(0, None, 1, "Scope", ""), (1, 0, 2, "Gone", ""), (2, 1, 3, "Gone too", ""), (3, None, 1, "Scope", ""), (4, 3, 2, "a", ""), (5, 3, 2, "b", "")]))
    assert sorted(r.line_no for r in merged.collect()) == [3, 4, 5]


def test_subtrees_and_ancestors(spark):
    rows = [(0, None, 2, "a", ""), (3, None, 1, "b", ""), (4, 3, 3, "c", ""), (5, 3, 2, "d", ""), (7, 5, 4, "e", ""), (9, None, 1, "f", "")]
    got = ordered.with_ancestors(ordered.with_subtrees(tree(spark, rows)), "title").orderBy("line_no").collect()
    assert [(r.until if r.until < 99 else None, r.up) for r in got] == [(3, []), (9, []), (5, ["b"]), (9, ["b"]), (9, ["b", "d"]), (None, [])]


def test_sections_whose_parent_was_dropped(spark):
    whole = [(0, None, 1, "One", "a"), (3, 0, 2, "First", "b"), (6, 3, 3, "Deep", "c"), (9, 0, 2, "Second", "d"), (12, 9, 3, "Low", "e"), (15, None, 1, "Two", "f")]
    a, b = tree(spark, whole), tree(spark, [r for r in whole if r[0] != 9])
    # Without line 9, line 12 is the second below line 6's parent and no first one of its own.
    got = {(r.a_line, r.b_line, r.kind) for r in V.pair_by_position(a, b).collect()}
    assert got == {(0, 0, "paired"), (3, 3, "paired"), (6, 6, "paired"), (9, None, "missing_in_b"), (None, 12, "missing_in_a"), (15, 15, "paired")}
    got = {(r.a_line, r.b_line, r.diff_type) for r in V.align_sections(a, b).collect()}
    assert got == {(0, 0, "equal"), (3, 3, "equal"), (6, 6, "equal"), (15, 15, "equal"), (9, None, "deleted"), (None, 12, "added")}
    # Without line 0, lines 3 and 9 stand beside line 15, each with a place of its own.
    got = [(r.a_line, r.b_line) for r in V.pair_by_position(a, tree(spark, whole[1:])).collect()]
    assert sorted(y for _, y in got if y is not None) == sorted({y for _, y in got if y is not None}) and {y for _, y in got} >= {3, 9, 15}


def test_parents_of_whole_tables_stay(spark):
    rows = [(0, None, 2, "a", ""), (3, None, 1, "b", ""), (4, 3, 3, "c", ""), (5, 3, 2, "d", ""), (7, 5, 4, "e", ""), (8, 5, 3, "g", ""), (9, None, 1, "f", "")]
    got = ordered.with_parents(tree(spark, rows)).orderBy("line_no").collect()
    assert [r.parent for r in got] == [r[1] for r in rows]


def test_alike_pairs_are_found_where_a_document_lies(spark, capsys):
    frame = lambda own: spark.range(50).selectExpr("id % 5 as doc_id", f"id as {own}", "concat('abcé', chr(cast(97 + id % 26 as int))) as key").repartition(3)
    pairs = V.alike_pairs(frame("l"), frame("r"), ["doc_id"], 0.8)
    pairs.explain()
    told = capsys.readouterr().out
    # One exchange of each side, not one of each character or pair.
    assert told.count("Exchange hashpartitioning") <= 2 and len(pairs.collect()) >= 50


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def _two_sides(spark):
    lines = [(d, k, t) for d in range(4) for k, t in enumerate(["a b", "x", "a  b", "", ", .", f"q{d}", "x", "z Z", "x y"] * (d + 1))]
    a = spark.createDataFrame(lines, "doc_id int, line_no bigint, text string")
    return a, a.where("line_no % 5 <> 3").withColumn("text", F.when(F.col("line_no") % 7 == 2, F.concat("text", F.lit(" new"))).otherwise(F.col("text")))


def test_line_diff_shuffles_each_line_once(spark):
    a, b = _two_sides(spark)
    got = V.line_diff(a, b)
    assert _plan(got)[1].count("Exchange hashpartitioning") == 1
    want = []
    for d in range(4):
        sides = []
        for df in (a, b):
            seen, own = {}, {}
            for r in df.where(F.col("doc_id") == d).orderBy("line_no").collect():
                key = "".join(r.text.split())
                seen[key] = seen.get(key, 0) + 1
                own[key, seen[key]] = r
            sides.append(own)
        for k in sides[0].keys() | sides[1].keys():
            x, y = sides[0].get(k), sides[1].get(k)
            want.append((d, 1 if x is None else -1 if y is None else 0, x and x.line_no, y and y.line_no, (x or y).text))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    none = spark.createDataFrame([(1, 0, None), (None, 1, "x")], "doc_id int, line_no bigint, text string")
    assert sorted(r.op for r in V.line_diff(none, none).collect()) == [-1, -1, 1, 1]  # null equals nothing


def test_page_texts_are_shuffled_little_more_than_once(spark):
    rows = [(d, p, f"w{(p + s) // 2} v{p % 5} u" + " x" * (p % 3)) for d in (1, 2) for p in range(0, 75) for s in (d - 1,)]
    a = spark.createDataFrame(rows, "doc_id int, page bigint, text string")
    b = a.withColumn("page", F.col("page") + 1).where("page % 9 <> 4")
    got = V.match_pages(a, b, 2)
    assert _plan(got)[1].count("Generate explode(sequence") == 1  # b's pages alone, near the border of a block
    left, right = ({(r.doc_id, r.page): set(r.text.split()) for r in df.collect()} for df in (a, b))
    pairs = [(d, p, q, len(x & y) / min(len(x), len(y))) for (d, p), x in left.items() for q in range(p - 2, p + 3) if (y := right.get((d, q)))]
    pairs = [r for r in pairs if r[3] >= 0.3]
    order = lambda r: (-r[3], abs(r[1] - r[2]), r[1], r[2])
    best = lambda key: {min((r for r in pairs if key(r) == k), key=order) for k in {key(r) for r in pairs}}
    assert sorted(map(tuple, got.collect())) == sorted(best(lambda r: r[:2]) & best(lambda r: (r[0], r[2]))) and len(pairs) > 300


def test_a_table_is_sought_with_one_shuffle_a_side(spark):
    a, b = _two_sides(spark)
    found = V.table_in_lines(a.where("line_no > 0").withColumnRenamed("line_no", "row_no"), b)
    assert _plan(found)[1].count("Exchange hashpartitioning") == 2
    assert {r.doc_id: r.rows_met for r in V.table_in_lines(a.withColumnRenamed("line_no", "row_no"), a).collect()} == {d: 3 for d in range(4)}
    one = spark.createDataFrame([(1, 0, "Only!"), (2, 0, " "), (3, 0, "p"), (3, 1, "q")], "doc_id int, line_no bigint, text string")
    got = V.table_in_lines(one.withColumnRenamed("line_no", "row_no"), one.where("line_no = 0").unionByName(one.where("doc_id = 1").withColumn("line_no", F.lit(5).cast("bigint"))))
    assert [tuple(r) for r in got.collect()] == [(1, 0, 1, None)]  # the last row stands twice; a table of two rows needs both


def test_pages_are_taken_apart_only_where_lengths_agree(spark):
    a, b = _two_sides(spark)
    diff = V.page_diff(V.page_text(a, 3), V.page_text(b, 3))
    assert "array_sort(" not in _plan(diff)[1]
    rows = spark.createDataFrame([("ab", "ba"), ("ab", "abb"), ("aab", "abb"), ("", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in rows.select(X.same_characters(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, None]
    assert "length" in _plan(rows.select(X.same_characters(F.col("a"), F.col("b"))))[0]


def test_exceptions_are_dealt_before_they_are_made_distinct(spark):
    from tallyweave.operators import reconcile as R

    rows = spark.createDataFrame([(1, 2, "f", "v"), (1, 2, "f", "v"), (1, 3, "f", None), (1, 3, "f", None)], "rec_id bigint, type_id int, field string, value string")
    got = R.unite(rows, rows.where("type_id = 2"))
    lines = _plan(got)[1].split("\n")
    assert max(k for k, x in enumerate(lines) if "HashAggregate" in x) < min(k for k, x in enumerate(lines) if "Exchange" in x)
    assert sorted(map(tuple, got.collect())) == [(1, 2, "f", "v"), (1, 3, "f", None)]


def plain_windows(lines, anchors, least=0.8):
    """For each anchor (number, k, text) of one document its window, by trying all."""
    table = X.comparison_points()
    bare = lambda t: "".join(chr(x) for x in (table[ord(c)] for c in t or "") if x >= 0)
    keys, best = [(n, bare(t)) for n, t in lines if bare(t)], {}
    for number, k, text in anchors:
        a = bare(text)
        for s in range(len(keys) if a else 0):
            for width in range(max(k, 1), min(k + 2, len(keys) - s) + 1):
                b = "".join(t for _, t in keys[s : s + width])
                score = 0.85 + 0.15 * min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else len(set(a) & set(b)) / len(set(a) | set(b))
                score = int(score * 1_000_000 + 0.5) / 1_000_000
                if score >= least:
                    best[number] = min(best.get(number, (0,)), (-score, s, width))
    return {number: (keys[s][0], width, -score) for number, (score, s, width) in best.items()}


def made_anchors(seed, letters, size):
    rng, docs = random.Random(seed), {}
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, size)))
    for d in range(40):
        lines = [(3 * n + d % 5, rng.choice([word(), word(), " ", "same", None])) for n in range(rng.choice([1, 3, 9, 30]))]
        anchors = []
        for n in range(rng.choice([1, 5, 20])):
            k, s = rng.randint(1, 4), rng.randrange(len(lines))
            text = " ".join(t or "" for _, t in lines[s : s + rng.randint(1, 3)])
            anchors.append((n, k, rng.choice([text, text + "!", text[1:], text[::-1], word(), None, text + text])))
        docs[d] = (lines, anchors + [(0, 1, "same")] * (d % 2))
    return docs


KINDS = [("ab", 3), ("abcdefgh 😀é", 14), ("".join(map(chr, range(0x4E00, 0x4E00 + 600))) + "，（", 20)]


@pytest.mark.parametrize("letters, size", KINDS)
@pytest.mark.parametrize("pairs, few", [(1 << 17, 4), (20, 0)])
def test_anchors_meet_windows_as_by_trying_all(monkeypatch, letters, size, pairs, few):
    monkeypatch.setattr(W, "PAIRS", pairs)
    monkeypatch.setattr(W, "FEW", few)
    monkeypatch.setattr(W, "SLICE", 1000 if few else 10**6)
    docs = made_anchors(size, letters, size)
    texts = lambda x: [{**r, "text": r["text"] or ""} for r in x]
    rows = [{"doc_id": d, "a": texts({"anchor": n, "k": k, "text": t} for n, k, t in a), "l": texts({"line_no": n, "text": t} for n, t in l)} for d, (l, a) in docs.items()]
    kinds = pa.schema({"doc_id": pa.int64(), "anchor": pa.int64(), "line_no": pa.int64(), "width": pa.int32(), "score": pa.float64()})
    batch = pa.RecordBatch.from_pylist(rows)
    told = [r for b in W.best_windows(iter([batch.slice(0, 0), batch.slice(0, 7), batch.slice(7)]), kinds, 0.8) for r in b.to_pylist()]
    got = {(r["doc_id"], r["anchor"]): (r["line_no"], r["width"], r["score"]) for r in told}
    assert len(got) == len(told) > 50 and got == {(d, n): x for d, (l, a) in docs.items() for n, x in plain_windows(l, a).items()}


def test_anchors_and_lines_are_shuffled_once_and_windows_never(spark):
    docs = made_anchors(14, *KINDS[1])
    lines = spark.createDataFrame([(d, n, t) for d, (l, _) in docs.items() for n, t in l], "doc_id bigint, line_no bigint, text string").repartition(3)
    anchors = spark.createDataFrame([(d, *r) for d, (_, a) in docs.items() for r in a] + [(None, 1, 1, "same"), (1, 99, None, "same"), (99, 1, 1, "same")], "doc_id bigint, anchor bigint, k int, text string")
    found = V.anchor_windows(lines, anchors)
    plan = _plan(found)[1]
    assert plan.count("Exchange hashpartitioning") == 2 and "Generate" not in plan
    got = {(r.doc_id, r.anchor): (r.line_no, r.width, r.score) for r in found.collect()}
    # A mark of two code units is one character.
    assert got == {(d, n): x for d, (l, a) in docs.items() for n, x in plain_windows(l, a).items()}


def test_comparison_points_are_those_of_the_key(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x10000 or c % 97 == 0)]
    rows = spark.createDataFrame([(c, chr(c)) for c in points], "c int, text string").select("c", X.comparison_key(F.col("text")).alias("key")).collect()
    table = X.comparison_points()
    assert all(r.key == ("" if table[r.c] < 0 else chr(table[r.c])) for r in rows)


def test_anchors_need_no_package_on_the_executors(tmp_path):
    kinds = pa.schema({"doc_id": pa.int64(), "anchor": pa.int64(), "line_no": pa.int64(), "width": pa.int32(), "score": pa.float64()})
    (tmp_path / "f").write_bytes(cloudpickle.dumps(lambda batches: W.best_windows(batches, kinds, 0.8)))
    program = "import pickle, pyarrow as pa; f = pickle.load(open('f', 'rb')); print(*[r for b in f([pa.RecordBatch.from_pylist([{'doc_id': 1, 'a': [{'anchor': 1, 'k': 1, 'text': 'a b'}], 'l': [{'line_no': 5, 'text': 'ab'}]}])]) for r in b.to_pylist()]); import tallyweave"
    ran = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, capture_output=True, text=True, timeout=60, env={})
    assert "No module named 'tallyweave'" in ran.stderr and "'line_no': 5, 'width': 1, 'score': 1.0" in ran.stdout
