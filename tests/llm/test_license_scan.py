"""Licence scan: phrases against a plain search, matching statistics against brute force, covered templates."""

import random
import re

from shoplens.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ARGS = {"least": 3, "gap": 6, "share": 0.8, "short": 16}
MIT = dict(ls.TEXTS)["mit"]


def machine(templates=ls.TEMPLATES, least=3):
    return ls.Automaton(ls.PHRASES, templates, least)


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text):
    words = plain_words(text)
    at = sorted((i, label) for label, phrase in ls.PHRASES for i in range(len(words))
                if words[i:i + len(phrase.split())] == phrase.split())
    return (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None,
            ",".join(sorted({label for _, label in at})))


def test_phrases(llm_spark):
    rng = random.Random(4)
    pieces = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "the", "a", "MIT License", "CC-BY", "é"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += ["GNU\x00General_Public;license", "mit\x7flicense", "Kmit license", "mit license" * 3, None, "", "CC BY" * 2]
    got = ls.summary(ls.find(llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(texts[r["doc_id"]])
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_statistics_are_longest_runs():
    rng = random.Random(5)
    templates = [(str(t), " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 25)))) for t in range(8)]
    m = ls.Automaton([("p", "a b"), ("q", "c a b")], templates, 1)
    known = {tuple(w[i:j]) for _, t in [("", "a b"), ("", "c a b"), *templates] for w in [t.split()]
             for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    run = [rng.choice("abc") for _ in range(400)]
    for i, (state, length) in enumerate(m.statistics([m.ids[c.encode()] for c in run])):
        assert length == max(n for n in range(i + 2) if n == 0 or tuple(run[i + 1 - n:i + 1]) in known)
        here = {(t, e) for t, (_, text) in enumerate(templates, 2) for w in [text.split()]
                for e in range(length, len(w) + 1) if w[e - length:e] == run[i + 1 - length:i + 1]}
        assert set(m.places[state]) == here
        got = {p for p in m.hits[state] if m.sizes[p] <= length}
        assert got == {p for p, w in enumerate((["a", "b"], ["c", "a", "b"])) if run[max(0, i + 1 - len(w)):i + 1] == w}


def test_covered_templates():
    m = machine()

    def found(text):
        return [s for s in ls.scan(text, m, **ARGS)[1] if not s[5]]

    spans = found(f"Copyright Somebody\n\n{MIT}\n\nand code")
    assert [(s[0], s[1], s[4]) for s in spans] == [("mit", 2, 1.0)]
    words = MIT.split()
    changed = words[:20] + ["really"] * 4 + words[20:50] + words[52:]
    assert [s[0] for s in found(" ".join(changed))] == ["mit"]
    assert not found(" ".join(words[:40])) and 0 < ls.scan(" ".join(words[:40]), m, **ARGS)[2] < 0.8
    assert not found(" ".join(w for x in words for w in (x, "und")))
    assert len(found(f"{MIT}\n{MIT}")) == 2


def test_notices_keep_versions_apart():
    m = machine()
    for text, want in [("Licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
                       ("licensed under the GNU General Public License, version 2.", {"gpl", "gpl-2.0"}),
                       ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc-4.0"}), ("licensed under CC BY", {"cc-by"}),
                       (dict(ls.TEXTS)["gpl-2.0"], {"gpl", "gpl-2.0"}), (dict(ls.TEXTS)["lgpl-2.1"], {"lgpl-2.1"}),
                       (dict(ls.TEXTS)["bsd-3-clause"], {"bsd-3-clause"}), ("the license of this software", set())]:
        assert {s[0] for s in ls.scan(text, m, **ARGS)[1]} == want, text


def test_long_text_and_rows(llm_spark, messy, no_docs, clashing):
    big = ("zz qq " * 900_000) + MIT + (" the of and this" * 200_000)
    n, spans, score = ls.scan(big, machine(), **ARGS)
    assert n == len(plain_words(big)) and [s[:2] for s in spans] == [("mit", 1_800_000)] and score == 1.0
    rows = ls.summary(ls.find(messy)).collect()
    assert len(rows) == messy.count()
    want = sorted((d["doc_id"] is None, d["doc_id"] or 0, len(plain_words(d["text"]))) for d in messy.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"]) for r in rows) == want
    assert ls.find(no_docs).count() == 0
    out = ls.find(clashing)
    assert [out.columns.count(c) for c in ("n_words", "spans", "score")] == [1, 1, 1] and "verdict" in out.columns
    assert out.count() == messy.count()
