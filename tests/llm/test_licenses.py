"""License templates against regular expressions over words, tried at every start and end."""

import random
import re

import pytest

from shotloom.llm import licenses as li
from shotloom.llm.queries import op11_license_templates

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def pattern(template):
    out, pos = "", 0
    plain = lambda part: "".join(re.escape(w) + " " for w in words(part))
    for m in re.finditer(r"<<(\w+)(?:;[^>]*?match=(\d+)-(\d+))?[^>]*>>", template.text):
        out += plain(template.text[pos:m.start()])
        out += {"beginOptional": "(?:", "endOptional": ")?"}.get(m[1]) or f"(?:\\S+ ){{{m[2]},{m[3]}}}"
        pos = m.end()
    return re.compile(out + plain(template.text[pos:]))


def brute(text, templates):
    w = words(text)
    pats = [(t, pattern(t)) for t in templates]
    return sorted((s, e, t.kind, t.label) for s in range(len(w)) for e in range(s + 1, min(len(w), s + 40) + 1) for t, p in pats if p.fullmatch(" ".join(w[s:e]) + " "))


def found(docs, templates):
    return {r.doc_id: (r.n_words, [(s.start, s.end, s.kind, s.label) for s in r.spans], r.score) for r in li.find(docs, templates).collect()}


TEMPLATES = [
    li.Template("a", "x <<beginOptional>>y <<beginOptional>>z<<endOptional>><<endOptional>> x"), li.Template("b", "y <<var;name=n;match=1-3>> z"),
    li.Template("c", "<<beginOptional>>z<<endOptional>> <<var;name=n;match=0-2>> x y", "base"), li.Template("d", "x"), li.Template("a", "z-z, Z é"),
]


def test_random_texts_against_regular_expressions(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["x", "y", "z", "q", "X.", "é", "z-z"]) for _ in range(rng.randrange(0, 25)))) for i in range(150)]
    got = found(docs_of(rows, extra=True), TEMPLATES)
    for i, t in rows:
        assert got[i][:2] == (len(words(t)), brute(t, TEMPLATES)), t
    assert sum(len(g[1]) for g in got.values()) > 1000


def test_mandatory_wording_must_match_exactly(spark, docs_of):
    plain = re.sub(r"<<\w+Optional>>", "", li._MIT)
    short = re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", li._MIT, flags=re.S)
    bsd = re.sub(r"<<var;name=organization[^>]*>>", "The Example Society of Somewhere", re.sub(r"<<var;name=bullet[^>]*>>", "2.", li._BSD_3))
    rows = [(1, "Copyright 2020\n" + plain.upper()), (2, "** " + short), (3, plain.replace("sublicense", "lend")), (4, bsd), (5, bsd.replace("endorse or promote", "promote")), (6, "// SPDX-License-Identifier: Apache-2.0")]
    got = {i: {s[3] for s in v[1]} for i, v in found(docs_of(rows), (*li.BASE, *li.METHOD)).items()}
    assert got == {1: {"mit"}, 2: {"mit"}, 3: set(), 4: {"bsd-2", "bsd-3"}, 5: {"bsd-2"}, 6: {"apache-2"}}


def test_nulls_empty_long_and_repeated_rows(spark, docs_of):
    big, filler = 1 << 60, "under the " * 300_000
    rows = [(big + 1, filler + "MIT license"), (None, "x x"), (big + 3, "under the mit\x1flicense"), (big + 3, None), (4, ""), (5, "___ ...")]
    got = sorted((str(r.doc_id), r.n_words, [(s.start, s.kind) for s in r.spans], r.score) for r in li.find(docs_of(rows), li.BASE).collect())
    assert got == sorted([
        (str(big + 1), 600_002, [(599_998, "base")], 0.9375), ("None", 2, [], 0.0), (str(big + 3), 4, [(0, "base")], 0.9375), (str(big + 3), 0, [], 0.0), ("4", 0, [], 0.0), ("5", 0, [], 0.0),
    ])
    assert li.find(docs_of([]), li.BASE).count() == 0


@pytest.mark.parametrize("text", ["a <<beginOptional>> b", "a <<endOptional>>", "a <<var;name=x>>", "<<beginOptional>>a<<endOptional>>", "<<var;match=0-3>>"])
def test_faulty_templates(spark, docs_of, text):
    with pytest.raises(ValueError, match="template of q"):
        li.find(docs_of([(1, "a")]), [li.Template("q", text)])


def test_query_against_plain_loops(spark, texts):
    got = {r.doc_id: r for r in op11_license_templates(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(texts)
    for i, t, *_ in texts:
        w = words(t)
        hits = sorted((k, b.label) for b in li.BASE for k in range(len(w)) if w[k:k + len(words(b.text))] == words(b.text))
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(hits), ",".join(sorted({b for _, b in hits})))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
