"""Removed passages against a brute-force version of the same units, and planted passages."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from shoplens.llm import substring_dedup as sd
from .conftest import DOC_SCHEMA, prose


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lines(text, line_words):
    """First and end code point of lines and paragraphs of several lines, by their words' places."""
    out, paragraph, at = [], [], 0
    for line in [*text.split("\n"), ""]:
        words = [(at + m.start(), at + m.end()) for m in WORDS.finditer(line)]
        if len(words) >= line_words:
            out.append((words[0][0], words[-1][1]))
        if words:
            paragraph.append(words)
        else:
            whole = [w for ws in paragraph for w in ws]
            if len(paragraph) > 1 and len(whole) >= line_words:
                out.append((whole[0][0], whole[-1][1]))
            paragraph = []
        at += len(line) + 1
    return out


def brute(docs, min_words, line_words=14):
    """Spans to remove per (id, text), by comparing the units' words themselves."""
    occurrences, first = [], {}
    for d in {(d["doc_id"], d["text"]) for d in docs if d["text"]}:
        rank = -(1 << 63) if d[0] is None else d[0]
        _, starts, ends = sd.units(d[1], min_words)
        for kind, places in (("window", list(zip(starts.tolist(), ends.tolist()))), ("line", plain_lines(d[1], line_words))):
            for a, b in places:
                words = d[1][a:b].encode().lower().split()
                assert len(words) >= (min_words if kind == "window" else line_words)
                occurrences.append((rank, d, a, b, (kind, b" ".join(words))))
    for o in occurrences:
        if o[4] not in first or (o[0], o[2]) < (first[o[4]][0], first[o[4]][2]):
            first[o[4]] = o
    spans: dict = {}
    for o in occurrences:
        f = first[o[4]]
        if o[1] == f[1]:
            a, b = max(o[2], f[3]), o[3]
            if o[2] > f[2] and a < b:
                spans.setdefault(o[1], []).append([a, b])
        elif (o[0], o[2]) != (f[0], f[2]):
            spans.setdefault(o[1], []).append([o[2], o[3]])
    for key, some in spans.items():
        merged: list[list[int]] = []
        for a, b in sorted(some):
            if merged and merged[-1][1] >= a:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        spans[key] = merged
    return spans


def cut(text, spans):
    for a, b in reversed(spans):
        text = text[:a] + text[b:]
    return text


def test_rows(llm_spark, messy, no_docs, clashing):
    passage = prose(77, 60).replace("\n", " ")
    more = [(20 + i, prose(100 + i, 40 + i) + (" " if i % 2 else "\n") + passage + " " + prose(200 + i, 30), "en", "a", 1)
            for i in range(6)]
    docs = messy.union(llm_spark.createDataFrame(more, DOC_SCHEMA))
    rows = docs.collect()
    want = brute(rows, 25)
    got = sd.remove(docs).collect()
    assert len(got) == len(rows)
    key = lambda r: (str(r["doc_id"]), str(r["source"]), str(r["n_chars"]), str(r["lang"]))
    texts = {}
    for d in rows:
        texts.setdefault(key(d), []).append((d["doc_id"], d["text"]))
    for r in got:
        options = [(cut(t or "", want.get((i, t), [])) if t is not None else None,
                    [tuple(s) for s in want.get((i, t), [])]) for i, t in texts[key(r)]]
        assert (r["text"], [tuple(s) for s in r["spans"]]) in options
    removed = {r["doc_id"] for r in got if r["spans"]}
    assert removed == {2, 21, 22, 23, 24, 25}           # copies and later passages; ids 1 and 20 keep theirs
    for r in got:
        if r["doc_id"] in range(21, 26):
            assert sum(s["end"] - s["start"] for s in r["spans"]) > 0.6 * len(passage)
    assert sd.remove(no_docs).count() == 0
    other = sd.remove(clashing)
    assert other.columns.count("spans") == 1 and other.count() == messy.count()


def test_clean_documents_and_boilerplate_stay(llm_spark):
    header = "All rights reserved by the invented society of letters."
    rows = [(i, header + "\n" + prose(300 + i, 200), "en", "a", 1) for i in range(20)]
    got = sd.remove(llm_spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    assert all(not r["spans"] for r in got)
    assert sorted(r["text"] for r in got) == sorted(r[1] for r in rows)


def test_units_do_not_depend_on_surroundings():
    passage = prose(9, 70).replace("\n", " ")
    digests = [set(sd.units(prose(400 + i, 33 + i) + " x " + passage + " y " + prose(500 + i, 20), 25)[0].tolist())
               for i in range(20)]
    assert all(digests[0] & d for d in digests)


def test_spans_are_code_points():
    text = "😀 ñ " + prose(3, 40)
    _, starts, ends = sd.units(text, 25)
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in zip(starts, ends))
    assert np.all(starts < ends)


def test_repeat_inside_a_document_overlapping_itself(llm_spark):
    rows = [(1, "word " * 400, "en", "a", 1)]
    got = sd.remove(llm_spark.createDataFrame(rows, DOC_SCHEMA)).first()
    assert 0 < len(got["text"].split()) < 100               # the first occurrence stays whole


def test_every_passage_of_51_words_shares_a_unit():
    marked = prose(43, 400).split()
    for words in (marked, [w.strip(".") for w in marked]):
        for i in range(len(words) - 50):
            passage = " ".join(words[i:i + 51])
            a, b = (set(sd.units(f"{prose(50 + 2 * i + j, 30 + j)} x{j} {passage} y{j} {prose(j, 9)}", 25)[0].tolist())
                    for j in range(2))
            assert a & b


def test_passages_at_every_offset_go_whole(llm_spark):
    marked = prose(41, 51).replace("\n", " ")
    bare = " ".join(w.strip(".") for w in prose(42, 51).split())
    rows = [(0, prose(600, 90) + " " + marked + " " + prose(601, 80), "en", "a", 1),
            (1, prose(602, 33) + " " + bare + " " + prose(603, 70), "en", "a", 1)]
    rows += [(10 + i, prose(700 + i, 70 + i) + f" x{i} " + (marked, bare)[i % 2] + f" y{i} " + prose(800 + i, 60), "en", "a", 1) for i in range(40)]
    got = {r["doc_id"]: r for r in sd.remove(llm_spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    for i, text, *_ in rows:
        passage = (marked, bare)[i % 2]
        want = [(text.index(passage), text.index(passage) + len(passage))] if i >= 10 else []
        assert [tuple(s) for s in got[i]["spans"]] == want


def test_every_window_that_occurred_before_goes(llm_spark):
    rng = random.Random(5)
    pool = [prose(900 + i, 12 + 5 * i).split() for i in range(9)] + [["la"] * 40, ["ti", "to", "ta"] * 14]
    texts = [" ".join(w for _ in range(12) for p in [rng.choice(pool)]
                      for w in p[rng.randrange(len(p) // 2):rng.randrange(len(p) // 2, len(p) + 1)]) for _ in range(60)]
    docs = llm_spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOC_SCHEMA)
    want = brute(docs.collect(), 25)
    got = sd.remove(docs.repartition(4)).collect()
    assert {(r["doc_id"], tuple(tuple(s) for s in r["spans"])) for r in got} == \
        {(i, tuple(tuple(s) for s in want.get((i, t), []))) for i, t in enumerate(texts)}


def test_equal_lines_and_paragraphs_go(llm_spark):
    line = " ".join(f"word{i}" for i in range(16))
    wrapped = "\n".join(" ".join(f"part{i}{j}" for j in range(5)) for i in range(3))
    short = " ".join(f"few{i}" for i in range(13))
    rows = [(i, f"{prose(30 + i, 40)}\n{'  ' if i else ''}{line.upper() if i == 2 else line}\n\nnew{i}\n\n{wrapped}\n\nold{i}\n\n{short}\n{prose(60 + i, 30)}",
             "en", "a", 1) for i in range(4)]
    docs = llm_spark.createDataFrame(rows, DOC_SCHEMA)
    got = {r["doc_id"]: r for r in sd.remove(docs).collect()}
    assert got[0]["spans"] == []
    for i in range(1, 4):
        text = got[i]["text"]
        assert "word3" not in text.lower() and "part12" not in text and short in text
        assert [tuple(s) for s in got[i]["spans"]] == [tuple(s) for s in brute(docs.collect(), 25)[i, rows[i][1]]]
    kept = {r["doc_id"]: r["text"] for r in sd.remove(docs, line_words=17).collect()}
    assert all(line in kept[i].lower() for i in range(4))


def test_lines_are_found_in_any_white_space():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", "\n", "\n\n", "\t", " ", "\x0b", "\r\n", "ñ", "😀", "\x85", "\x1c"]) for _ in range(rng.randrange(0, 60)))
        assert sorted((a, b) for _, a, b in sd.lines(text, 3)) == sorted(plain_lines(text, 3)), repr(text)


def test_ids_of_other_types_and_common_units(llm_spark):
    line = " ".join(f"all{i}" for i in range(20))
    rows = [(f"id{i:04d}", f"{prose(i, 20)}\n{line}") for i in range(300)] + [(None, line)]
    docs = llm_spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    left = {r["doc_id"] for r in sd.remove(docs).where(F.col("text").contains("all3")).collect()}
    assert left == {None}                                   # a null id ranks first
