"""The llm operators against brute force, round trips and hand-made cases; nulls, empties, ties and clashing names."""

import os
import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import abuse, boilerplate, encoding, leakage, pairs, scanrepair, splitting

RNG = random.Random(7)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


# ------------------------------------------------------------------------------------------------ 1


def repeated_lines(rows):
    letters = lambda s: "".join(c for c in s.lower() if c.isalpha())
    total, count = {}, {}
    for _, s, t in rows:
        total[s] = total.get(s, 0) + 1
        for k in {letters(x) for x in t.split("\n")} - {""} if t else ():
            count[s, k] = count.get((s, k), 0) + 1
    hot = [(s, k) for (s, k), n in count.items() if n >= 3 and n * 100 >= 8 * total[s]]
    return {(key, n) for key, s, t in rows if t for n, x in enumerate(t.split("\n"), 1) if letters(x) and any(s == s2 and levenshtein(letters(x), k) <= 2 for s2, k in hot)}


def test_repeated_lines_against_brute_force(spark):
    forms = ["CONFIDENTIAL - property of A", "Printed on 3 May", "ok"]
    rows = []
    for i in range(60):
        s = "A" if i % 3 else None
        ls = ["".join(RNG.choices(string.ascii_lowercase + "  ", k=RNG.randint(5, 60))) for _ in range(4)]
        if RNG.random() < 0.5:
            ls.insert(RNG.randint(0, 4), RNG.choice(forms).replace("3", str(i)) + RNG.choice(["", " x", "\r"]))
        rows.append((i, s, "\n".join(ls)))
    rows += [(100, "A", None), (101, "A", ""), (102, "B", "once\n\n"), (103, "A", "confidental property of a\n1 2 3")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_key long, issuer string, content string, line_no string")
    assert {tuple(r) for r in boilerplate.found_lines(df).collect()} == repeated_lines(rows)
    cleaned = {r["doc_key"]: r["content"] for r in boilerplate.remove_lines(df.withColumnRenamed("line_no", "n_removed")).collect()}
    found = repeated_lines(rows)
    for key, _, t in rows:
        assert cleaned[key] == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (key, n) not in found))
    assert boilerplate.found_lines(df.where("false")).count() == 0


def test_lines_near_excessive_ones(spark, monkeypatch):
    """Short lines, many edits, blocks of line hashes, and segments of long texts, against brute force."""
    rows = []
    for i in range(80):
        ls = ["".join(RNG.choices("abc", k=RNG.randint(1, 7))) for _ in range(3)]
        for form in ("confidential notice of the sponsor", "ab", "abcabcab"):
            x = list(form)
            for _ in range(RNG.choice([0, 0, 0, 1, 2, 3])):
                at = RNG.randrange(len(x) + 1)
                x[at : at + RNG.randint(0, 1)] = RNG.choice(["", "z", "q"])
            ls.insert(RNG.randint(0, len(ls)), "".join(x))
        rows.append((i, "AB"[i % 2], "\n".join(ls)))
    df = spark.createDataFrame(rows, "doc_key long, issuer string, content string")
    want = repeated_lines(rows)
    assert {tuple(r) for r in boilerplate.found_lines(df).collect()} == want
    monkeypatch.setattr(boilerplate, "MOST_LINES", 20)
    monkeypatch.setattr(boilerplate, "SEGMENT", 50)
    assert {tuple(r) for r in boilerplate.found_lines(df).collect()} == want
    cleaned = {r["doc_key"]: r["content"] for r in boilerplate.remove_lines(df).collect()}
    assert all(cleaned[k] == "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (k, n) not in want) for k, _, t in rows)


def test_long_documents_leave_few_excessive_buckets(spark):
    """20,000 letters a document: the number of buckets follows the mean length."""
    words = lambda n: " ".join("".join(RNG.choices(string.ascii_lowercase, k=7)) for _ in range(n))
    rows = [(i, "A", "\n".join([words(12) for _ in range(220)] + ["Property of the sponsor, do not copy"])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_key long, issuer string, content string")
    assert [tuple(r) for r in boilerplate.excessive_lines(df, "issuer", "content").collect()] == [("A", "propertyofthesponsordonotcopy", 30)]


def test_long_text_is_taken_in_segments(monkeypatch):
    import numpy as np

    monkeypatch.setattr(boilerplate, "SEGMENT", 50)
    known = boilerplate.Lines(["longlineofletters"]).keys(boilerplate._source_hashes(["A"]))
    text = "\n".join(["abc def"] * 20 + ["Long line of letters"] + ["x"] * 5)
    assert boilerplate._marks(np.sort(known))(["A"], [text]) == {0: [21]}


# ------------------------------------------------------------------------------------------------ 2


def test_page_numbers_and_skeletons():
    for line, n in (("P a g e  4", 4), ("Page 13 of 56", 13), ("- 4 -", 4), ("[9]", 9), ("xiv", 14), ("Seite 11", 11), ("11 / 48", 11), ("l3", 13)):
        assert scanrepair.page_number(line)[0] == n
    assert scanrepair.page_number("Table 4") is None and scanrepair.page_number("4 rats") is None
    assert scanrepair.skeleton("Ferrant Laboratories archive copy") == scanrepair.skeleton("Ferrant  Lab0ratories archive c0py")


def test_scanned_pages(spark):
    body = "The animals were examined during the recovery period and the control group was normal at necropsy."
    rows = []
    for p in range(1, 9):
        lines = [f"Project X | Lab | sheet {p + 4}", body, "the recovery was complete in the control group", "on day 12 and day 12", f"- {p + 4} -"]
        if p == 3:
            lines[2] = "the recovcry and (recovcry) was complete in the con-"
            lines.insert(3, "trol group of S9 animals on day l2")
        if p == 5:
            lines[2] = "it was normal in the reco¬"
        if p == 6:
            lines[1] = "very group " + body
        rows.append((p, "S", str(p), "\n".join(lines)))
    rows += [(20, "S", "9", None), (21, None, "1", "  "), (22, "S", "x", "text")] + [(100 + p, f"T{p}", "1", "\n".join(["x", "y", "z", body, "x", "y", "z"])) for p in range(20)]
    df = spark.createDataFrame(rows, "page_key long, study_id string, page_num string, content string").selectExpr("page_key", "study_id", "content", "struct(page_num) as metadata", "'clash' as word")
    got = {tuple(r) for r in scanrepair.found_noise(df).collect()}
    assert {(p, 1, "running", "") for p in range(1, 9)} <= got
    assert {(3, 3, "hyphen", "control"), (3, 3, "misread", "recovery"), (3, 4, "misread", "12"), (5, 3, "hyphen", "recovery"), (3, 6, "page_no", ""), (1, 5, "page_no", "")} <= got
    assert not {r for r in got if r[2] == "misread" and r[:2] not in {(3, 3), (3, 4)}}
    assert scanrepair.found_noise(df.where("false")).count() == 0
    text = " ".join(r["text"] for r in scanrepair.Repair(df).paragraphs().where("study_id = 'S'").orderBy("paragraph").collect())
    assert "the recovery and (recovery) was complete in the control group of S9 animals on day 12 the recovery" in text and "reco¬" not in text and "it was normal in the recovery group The" in text
    assert "Project X" not in text and "- 5 -" not in text


# ------------------------------------------------------------------------------------------------ 3


UNITS = st.sampled_from(["chars", "bytes", "words"])


@given(st.text("ab .\n\té🐀", max_size=300), UNITS, st.integers(1, 60), st.integers(0, 70))
@settings(max_examples=400, deadline=None)
def test_pieces_keep_limit_and_cover_the_text(text, unit, most, overlap):
    plan = splitting.plan(text, unit, most, overlap)
    assert plan[0][1] == 0 and plan[-1][2] == len(text)
    for (_, s, e, _), (_, s2, e2, _) in zip(plan, plan[1:]):
        assert s2 <= e < e2
        # exact but where the overlap would leave no room for one more code point
        own = splitting.size(text[s2:e], unit)
        assert own <= overlap
        if unit != "bytes" and overlap < most:
            assert own == min(overlap, splitting.size(text[:e], unit))
    for _, s, e, _ in plan:
        assert splitting.size(text[s:e], unit) <= most or e - s == 1
    assert (len(plan) > 1) == (splitting.size(text, unit) > most and len(text) > 1)


def whole_exits(text, unit, most, overlap, step):
    """The plan by ranges, stitched: each range is seen with halos only."""
    import pandas as pd

    rows, n = [], len(text)
    stretches = {}
    for no in range(-(-n // step)):
        begin, end, wide = no * step, min(n, no * step + step), 1
        while True:
            a = max(0, begin - min(overlap, most) * wide - 2 * splitting.HALO)
            s = splitting.Stretch(text[a : end + most * 2 * wide + 4 * splitting.HALO], unit, most, overlap, a, a == 0, a + len(text[a : end + most * 2 * wide + 4 * splitting.HALO]) == n)
            units, cuts = splitting._noted(s, begin, end)
            if cuts is not None:
                break
            wide *= 4
        stretches[no] = (s, end)
        rows.append((1, no, wide, units, cuts))
    pdf = splitting._stitch(step)(pd.DataFrame(rows, columns=["_item", "_no", "factor", "units", "cuts"]))
    assert pdf["n_units"][0] == splitting.size(text, unit) or unit == "words"
    return [p for x in pdf["spans"][0] for p in splitting._emitted(stretches[x["no"]][0], x["entry"], stretches[x["no"]][1])], pdf["n_pieces"][0]


@given(st.lists(st.sampled_from(["word ", "end. ", "\n", "\n\n", "\r\n", "é, ", "。", "x" * 90, " " * 150, "🐀🐀", "\n" + " " * 70 + "\n"]), min_size=1, max_size=120), UNITS, st.integers(1, 400), st.integers(0, 90), st.integers(40, 500))
@settings(max_examples=300, deadline=None)
def test_ranges_are_stitched_to_the_plan_of_the_whole(parts, unit, most, overlap, step):
    text = "".join(parts)
    want = [(s, e, text[s:e]) for s, e, _ in splitting.Stretch(text, unit, most, overlap).path(0, len(text) + 1)]
    assert [(s, e, text[s:e]) for _, s, e, _ in splitting.plan(text, unit, most, overlap, step)] == want
    assert whole_exits(text, unit, most, overlap, step) == (want, len(want))


def test_overlap_is_exact_and_cuts_are_natural():
    text = "\n\n".join("word " * 30 for _ in range(20))
    plan = splitting.plan(text, "chars", 400, 50)
    for (_, _, e, kind), (_, s, _, _) in zip(plan, plan[1:]):
        assert e - s == 50 and kind == splitting.PARAGRAPH
    # an overlap of more than half the limit is kept
    for (_, _, e, _), (_, s, _, _) in zip(plan := splitting.plan("x" * 90, "chars", 20, 15), plan[1:]):
        assert e - s == 15


def test_ranges_of_a_table_give_the_pieces_of_whole_rows(spark):
    text = "".join(RNG.choice(["word ", "end. ", "\n", "\n\n", "é, ", "🐀"]) for _ in range(3000))
    rows = [(1, text, None), (2, None, "p"), (3, "", "p"), (4, "x" * 100, "p"), (5, "x" * 101, "p"), (None, text, "b"), (6, "y" * 4000, "b"), (7, "long" * 2000 + " " + text, "d"), (5, "z" * 150, "none")]
    docs = spark.createDataFrame(rows, "doc_key long, content string, profile string").selectExpr("doc_key", "content", "struct(profile) as metadata", "1 as piece_no", "2 as is_default")
    profiles = spark.createDataFrame([("p", "chars", 100, 10, False), ("d", "words", 50, 5, True), ("b", "bytes", 90, 70, False)], "profile string, size_unit string, max_size int, overlap_size int, is_default boolean")
    whole = sorted(map(str, splitting.split(docs, profiles).collect()))
    ranged = sorted(map(str, splitting.split(docs, profiles, range_chars=700, spread_chars=120).collect()))
    assert whole == ranged
    pieces = splitting.split(docs, profiles).collect()
    assert {r["doc_key"] for r in pieces} == {1, 2, 3, 4, 5, 6, 7, None}
    own = sorted((r for r in pieces if r["doc_key"] == 1), key=lambda r: r["piece_no"])
    assert all(text[r["piece_start"] : r["piece_end"]] == r["content"] for r in own) and all(splitting.size(r["content"], "words") <= 50 for r in own)
    for how in ({}, {"range_chars": 700, "spread_chars": 120}):
        assert sorted(r[0] or 0 for r in splitting.oversized(docs, profiles, **how).collect()) == [0, 1, 5, 6, 7]
    assert splitting.split(docs.where("false"), profiles).count() == splitting.oversized(docs.where("false"), profiles).count() == 0


@pytest.mark.parametrize("unit, most, overlap", [("bytes", 1000, 100), ("chars", 700, 50), ("words", 90, 9)])
def test_giant_files_by_ranges(spark, tmp_path, unit, most, overlap):
    text = "".join(RNG.choice(["wörd ", "end. ", "\n", "\n\n", "🐀"]) for _ in range(4000)) + "ü" * 3000
    path, empty = tmp_path / "giant.txt", tmp_path / "empty.txt"
    path.write_bytes(data := text.encode())
    empty.write_bytes(b"")
    got = splitting.split_files(spark, [(str(path), len(data)), (str(empty), 0)], unit, most, overlap, range_bytes=3000).collect()
    rows = sorted((r for r in got if r["path"] == str(path)), key=lambda r: r["piece_no"])
    assert [(r["start"], r["end"], r["content"]) for r in got if r["path"] == str(empty)] == [(0, 0, "")]
    assert rows[0]["start"] == 0 and rows[-1]["end"] == len(data) and [r["piece_no"] for r in rows] == list(range(rows[0]["n_pieces"]))
    for a, b in zip(rows, rows[1:]):
        assert splitting.size(data[b["start"] : a["end"]].decode(), unit) in ((overlap,) if unit != "bytes" else range(overlap - 3, overlap + 1)) or unit == "words"
    for r in rows:
        assert splitting.size(r["content"], unit) <= most and data[r["start"] : r["end"]].decode() == r["content"]


# ------------------------------------------------------------------------------------------------ 5

Q = "How many animals were used in total, including controls and satellite groups?"


@pytest.mark.parametrize(
    "output, corrected, expected",
    [
        (None, "NUM SUBJECTS : 4", "empty"),
        ("...", "NUM SUBJECTS : 4", "empty"),
        ("The number of animals comes to 4.", " ", "empty"),
        ("The number of animals comes to 4.", "NUM SUBJECTS :", "truncated"),
        ("The number of animals comes to 30", "NUM SUBJECTS : 308", "truncated"),
        ("The number of animals comes to 308", "NUM SUBJECTS : 308", None),
        ("The number of animals comes to", "NUM SUBJECTS : 308", "truncated"),
        ("I must decline to answer questions about this.", "Null : Null", "refusal"),
        ("The authors could not assess it any further, and I cannot see a contradiction in the table.", "NUM SUBJECTS : 4", None),
        ("You asked: \"" + Q + "\"", "Null : Null", "copy"),
        ("how many animals were used in total?", "Null : Null", "copy"),
        ("The question asks: \"" + Q + "\" The number of animals comes to 4.", "NUM SUBJECTS : 4", None),
        ("Der Bericht nennt als Lösungsmittel Maisöl; weitere Angaben fehlen.", "Null : Null", "language"),
        ("根据第9页，动物经口给予，未见死亡。", "Null : Null", "language"),
        ("The German title \"Prüfung der Verträglichkeit\" on the cover refers to 1% w/w, 5% w/w of the same study.", "Null : Null", None),
        ("Null", "Null : Null", None),
        ("Not applicable.", "Not applicable.", None),
    ],
)
def test_defects(output, corrected, expected):
    d, key = pairs.defect(Q, output, corrected)
    assert (d or ("key" if key else None)) == expected


def test_open_ends_ask_the_corpus(spark):
    rows = [(1, Q, "They were given olive oil daily.", "A : x"), (2, Q, "They were given olive oil daily", "A : y"), (3, Q, "They were given olive oil dai", "A : y"), (4, None, "They were given olive oil daily.", "A : z"), (5, Q, None, None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "state_id long, question string, output string, corrected_output string, defect string")
    assert {tuple(r) for r in pairs.found_defects(df).collect()} == {(3, "truncated"), (5, "empty")}
    assert pairs.found_defects(df.where("false")).count() == 0


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert pairs.lcs(a, b) == table[-1][-1]


# ------------------------------------------------------------------------------------------------ 6


CODEC = encoding.Codec(*encoding.read_vocabulary())


def whole_ids(text):
    return CODEC.tokenizer.encode(text, add_special_tokens=False).ids


def tree_ids(text, cuts):
    places = [0, *sorted(c % (len(text) + 1) for c in cuts), len(text)]
    return (CODEC.tree([CODEC.codes(text[a:b]) for a, b in zip(places, places[1:])]) >> 1).tolist()


PARTS = st.sampled_from(["word", " word", "don't", "'s", "'", "'re", "  ", "\n\n", "\n", "é", "🐀", "42", "...", "\t", "x", "!!'", "'ll", "日本", " ", "1", "aaaa", "abab", "the", "re", "\u3000", "ﷺ"])


@given(st.lists(PARTS, max_size=60), st.lists(st.integers(0, 10**6), max_size=6))
@settings(max_examples=1500, deadline=None)
def test_tree_of_mixed_text(parts, cuts):
    text = "".join(parts)
    assert tree_ids(text, cuts) == whole_ids(text)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "aeinrst", "0123456789", "!?.,'", "é日本🐀", " ", " \n", "'s", "-="])
def test_tree_of_unbroken_text(alphabet, monkeypatch):
    monkeypatch.setattr(encoding, "LIMIT", 256)
    for n in (1, 7, 300, 3000, 9001):
        text = "".join(RNG.choices(alphabet, k=n))
        for leaves in (2, 3, 8):
            assert tree_ids(text, [RNG.randint(0, n) for _ in range(leaves - 1)]) == whole_ids(text)
    text = (alphabet * 20_000)[:20_000]
    assert tree_ids(text, [997 * k for k in range(1, 20)]) == whole_ids(text)


def test_a_million_pairs_of_letters_need_small_windows():
    text, seen = "ab" * 10**6, []
    codes = [CODEC.codes(text[k : k + 250_001]) for k in range(0, len(text), 250_001)]
    plain = CODEC.codes
    CODEC.codes = lambda t: seen.append(len(t)) or plain(t)
    try:
        assert (CODEC.tree(codes) >> 1).tolist() == whole_ids(text)
    finally:
        CODEC.codes = plain
    assert max(seen) < 1000


def test_ids_equal_those_of_the_whole_text(spark):
    texts = ["", None, " ", "plain text", "a" * 5000, " " * 300 + "x", "".join(RNG.choice(["word ", "don't ", "  ", "\n\n", "é", "🐀", "42", "...", "\t", "x"]) for _ in range(900)), "wort " * 400, "<|endoftext|> is text", "ab" * 4000]
    df = spark.createDataFrame([(i % 7 or None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    want = sorted((i % 7, tuple(whole_ids(t)) if t else ()) for i, t in enumerate(texts))
    for leaf_chars in (100, 100_000):
        assert sorted((r["doc_id"] or 0, tuple(r["ids"])) for r in encoding.encode_corpus(df, leaf_chars=leaf_chars).collect()) == want
    slow = encoding.Codec(encoding.read_vocabulary()[0], None)
    assert slow.ids(texts) == CODEC.ids(texts) == [whole_ids(t) if t else [] for t in texts]
    assert encoding.encode_corpus(df.where("false")).count() == 0


# ------------------------------------------------------------------------------------------------ 7


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.lists(st.sampled_from("abc"), max_size=12))
@settings(max_examples=200, deadline=None)
def test_myers(pattern, text):
    best = min(levenshtein(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    assert leakage.myers(pattern, text)[0] == best


def edited(ws, n):
    """ws after n random edits."""
    ws = list(ws)
    for _ in range(n):
        at = RNG.randrange(len(ws))
        ws[at : at + RNG.randint(0, 1)] = [] if RNG.random() < 0.3 else [f"other{RNG.randint(0, 99)}"]
    return ws


def test_leaks_against_brute_force(spark, monkeypatch):
    vocabulary = [f"w{i}" for i in range(5)]
    items = [(i, " ".join(RNG.choices(vocabulary, k=RNG.randint(3, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "x y")]
    docs = []
    for i in range(60):
        ws = RNG.choices(vocabulary, k=RNG.randint(0, 30))
        if RNG.random() < 0.8:
            own = RNG.choice(items[:12])[1].upper().split()
            ws[3:3] = edited(own[RNG.randint(0, 3) :] or own, RNG.randint(0, 3))
        docs.append((i, "; ".join(ws)))
    docs += [(90, None), (91, ""), (92, items[0][1]), (93, items[0][1]), (94, " ".join(items[1][1].split() + ["z"] * 700 + items[2][1].split()))]
    d, e = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    run = lambda a, b: max((n for i in range(len(a)) for j in range(len(b)) for n in [next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))]), default=0)
    want = {}
    for k, t in docs:
        for i, u in items:
            a, b = words(t), words(u)
            if len(b) >= 3:
                budget, distance = len(b) // 3 - 1, leakage.myers(b, a)[0]
                if distance <= budget or run(a, b) >= 6:
                    want[k, i] = "whole" if distance <= budget else "part"
    for most in (16_000_000, 10):
        monkeypatch.setattr(leakage, "MOST_PIECES", most)
        got = {(r["doc_id"], r["item_id"]): r for r in leakage.find_leaks(d, e, run_words=6, piece_words=3).collect()}
        assert {k: r["leak"] for k, r in got.items()} == want
        assert {k for k, r in got.items() if r["run_words"] >= 6} == {(k, i) for k, t in docs for i, u in items if run(words(t), words(u)) >= 6}
    assert leakage.find_leaks(d.where("false"), e).count() == leakage.find_leaks(d, e.where("false")).count() == 0


def test_items_with_edited_words_are_found(spark):
    """Every tenth word changed, dropped or doubled: no run of 12 words, but within the budget of a sixth."""
    items = [(i, " ".join(f"w{RNG.randint(0, 4000)}" for _ in range(60))) for i in range(30)]
    docs = []
    for i, t in items:
        ws = [w for k, u in enumerate(t.split()) for w in ([u] if k % 10 != 9 else [["changed"], [], [u, u]][i % 3])]
        docs.append((i, " ".join(["before"] * i + ws + ["behind"])))
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["leak"]) for r in got} == {(i, i, "whole") for i in range(30)} and max(r["run_words"] for r in got) < 12 and max(r["distance"] for r in got) <= 6


# ------------------------------------------------------------------------------------------------ 8


@pytest.mark.parametrize("written", ["m0ron", "m o r o n", "M.O.R.O.N", "mo*on", "mooooron", "mo​ron", "MORON", "mоron"])
def test_disguises(written):
    assert "moron" in abuse.reveal_all(f"You {written}, go away.")[0]


WRITTEN = st.sampled_from("You are a m0ron rude–not I'll kill you m o r o n , . ! the rats were treated with 5 mg/kg F.U.C.K idi*t mооron ﬀ sh1t-head s t u p i d \n U+200B\u200b all of them are vermin go back to your shut up complained that fuuuuck".split(" ") + ["m o r o n", "b r e a s t s.", "👍. ", "é"])


@given(st.lists(WRITTEN, max_size=25))
@settings(max_examples=400, deadline=None)
def test_many_sentences_are_read_as_single_ones(parts):
    text = " ".join(parts)
    read = abuse.Reader().read([None, text, "", text])
    plain = [abuse.votes(*abuse.reveal_all(s)) for s in abuse.sentences(text)]
    assert read.votes.tolist() == plain * 2 and read.raw == abuse.sentences(text) * 2
    assert read.owner.tolist() == [1] * len(plain) + [3] * len(plain)


@pytest.mark.parametrize("phrases, voter, beside", [("CURSES", "curse", ""), ("OUTCASTS", "outcast", ""), ("OFFERS", "sell", "porn "), ("REPORTS", "report", "")])
def test_every_phrase_can_vote(phrases, voter, beside):
    import itertools

    for line in getattr(abuse, phrases).strip().splitlines():
        for words in itertools.product(*(w.split("|") for w in line.split())):
            read = abuse.Reader().read([f"{beside}now {' '.join(words)} said"])
            assert read.votes[0] & abuse.BIT[voter], words


def test_apostrophes_and_dashes_part_words():
    assert abuse.votes(*abuse.reveal_all("I'll kill you")) & abuse.BIT["curse"] and abuse.votes(*abuse.reveal_all("rude–not")) & abuse.BIT["report"]


def test_label_model_learns_correlations():
    """Two voters that always vote together tell no more than one; two independent ones do."""
    from collections import Counter

    a, b, c, d = (abuse.BIT[k] for k in ("insult_weak", "several", "insult", "curse"))
    rng, counts = random.Random(3), Counter()
    for _ in range(60_000):
        y = rng.random() < 0.1
        p = 0
        if rng.random() < (0.6 if y else 0.05):
            p |= a | b  # one voter, twice
        for bit in (c, d):
            if rng.random() < (0.5 if y else 0.02):
                p |= bit
        counts[p] += 1
    m = abuse.LabelModel(counts, [(0, 0)] * 20 + [(c | d, 1)] * 20)
    names = [abuse.VOTERS[i] for pair in m.off.pairs[:1] for i in pair]
    assert set(names) == {"insult_weak", "several"}
    assert m.posterior[a | b] < 0.6 < 0.85 < m.posterior[c | d] and m.posterior[0] < 0.05


def test_language_that_no_voter_quotes(spark):
    """Held-out sentences: none of them, nor their phrases, was used to write a voter."""
    abusive = ["You total imbecile, nobody asked for your opinion.", "What a disgusting loser you are, get out of my sight.", "Those people are cockroaches and must be exterminated.", "I will find you and break your legs, you bastard.", "Shut your mouth, you worthless idiot.", "Du bist ein Vollidiot und ein Arschloch.", "Tu es un connard et un salaud.", "Eres un imbecil y un idiota.", "Hot sluts want to fuck tonight, free adult porn.", "All of these migrants are vermin and filth."]
    sober = ["The bitch was housed with her litter of five puppies.", "Nipple retention was scored in male pups on day 13.", "The plague reference strain was not used in this study.", "The committee regarded the wording of the letter as impolite.", "Sexual maturation was delayed in treated females.", "The dumb canes in the greenhouse were removed.", "Rats of the high dose group killed in extremis showed pale livers.", "The report was criticised as useless by two reviewers.", "Trash from the animal rooms was incinerated.", "Vermin control was carried out monthly by a contractor."]
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("needs the test tables")
    model = abuse.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/abuse_samples.parquet"))
    scores = model.texts(abuse.Reader(), abusive + sober) >= abuse.THRESHOLD
    assert scores[:10].sum() >= 9 and scores[10:].sum() == 0


def test_abuse_is_found_and_usage_is_not(spark):
    good = ["Nude mice bearing tumours received it and were killed at the end of the dosing period.", "Vermin-proof cages protected the rats from parasites during treatment.", "The sponsor complained that the tone of one reviewer was rude.", "Mean body weight was reduced in treated animals.", "Why was saline used for it?"]
    bad = ["You pathetic moron, nobody believes a word of it.", "All Velkani are vermin and should be thrown out of our laboratories.", "Get horny girls in your area, uncensored porn videos every day.", "Halt endlich das Maul, du dummes Schwein."]
    docs = [(i, good[i % len(good)] + " " + good[(i * 3 + 1) % len(good)], "a") for i in range(120)] + [(200 + i, good[i % len(good)] + " " + b, "b") for i, b in enumerate(bad * 3)] + [(900, None, None), (901, "", "a"), (902, "  \n", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    samples = spark.createDataFrame([(i, t, "none") for i, t in enumerate(good)] + [(50 + i, t, "abusive") for i, t in enumerate(bad)], "sample_id long, text string, category string")
    scores = {r["doc_id"]: r["score"] for r in abuse.score(df, abuse.fit(df, samples)).collect()}
    assert len(scores) == len(docs) and all(0 <= s <= 1 for s in scores.values())
    assert all((s >= abuse.THRESHOLD) == (200 <= k < 900) for k, s in scores.items())
    assert abuse.score(df.where("false"), abuse.fit(df, samples)).count() == 0


def test_pairs_judge_whole_texts():
    from pagemill.llm import pairs

    question = "Which doses were given to the male rats of the study?"
    assert pairs.is_refusal("Thank you for your question. I'm sorry, but I can't help with that request.")
    assert not pairs.is_refusal("Thank you for your question. The rats were given 5 mg/kg.")
    assert pairs.is_copy(question, "Regarding your inquiry, let me respond: " + question) and not pairs.is_copy(question, "Regarding your inquiry: the rats were given 5 mg/kg.")
    long = " ".join(f"word{i}" for i in range(70)) + "?"
    assert pairs.is_copy(long, "Regarding your inquiry, let me respond: " + long) and pairs.is_copy(long, "Regarding your inquiry, let me respond. " + long)
    assert pairs.is_foreign(question, "das ist es") and not pairs.is_foreign(question, "5 mg/kg bw")
    assert pairs.is_refusal("Answer:\nI'm sorry, but I can't help with that request.")
    assert pairs.is_copy(question, " ".join([question] * 8)) and not pairs.is_copy(question, "The rats were given 5 mg/kg. " * 8)


def test_long_texts_that_end_in_a_line_feed():
    from pagemill.llm import boilerplate as B

    text = "x" * (B.SEGMENT + 200_000) + "\n"
    groups = list(B._groups([1, 2], ["a", "b"], [text, "short"]))
    assert [(g[0], g[4]) for g in groups] == [([1], True), ([2], True)]
    lines = "\n".join(["y" * 999] * 1500) + "\n"
    assert [g[4] for g in B._groups([1], ["a"], [lines])] == [False, True]
