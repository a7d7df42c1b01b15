"""License scans: markup, automata against regular expressions, phrases against plain loops, odd rows."""

import random
import re

import pytest

from fieldwave.llm import license_scan as ls

SCHEMA = "doc_id long, text string, labels string, SPANS int, n_chars long"
MIT = re.sub(r"<<[^>]*>>", " ", dict((len(t), t) for label, t in ls.TEMPLATES if label == "mit")[max(len(t) for label, t in ls.TEMPLATES if label == "mit")])


def labels_of(text):
    return ls.scan_text(text, [], [ls.Automaton(n, t) for n, t in ls.TEMPLATES])[5]


def test_markup():
    assert ls.parse("A b<<beginOptional>>c <<var;x;3>><<beginOptional>>d<<endOptional>><<endOptional>>, e") == [b"a", b"b", [b"c", 3, [b"d"]], b"e"]
    for wrong in ("a <<beginOptional>> b", "a <<endOptional>>"):
        with pytest.raises(ValueError):
            ls.parse(wrong)
    with pytest.raises(ValueError):
        ls.Automaton("x", "<<var;a;3>>")


def test_automata_accept_what_regular_expressions_accept():
    rng = random.Random(3)

    def template(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            out.append(f"<<var;v;{rng.randint(0, 3)}>>" if kind < 0.2 else f"<<beginOptional>>{template(depth - 1)}<<endOptional>>" if kind < 0.45 and depth else rng.choice("abc"))
        return " ".join(out)

    hits = 0
    for _ in range(400):
        t = "a " + template(2) + " b"
        auto, rule = ls.Automaton("t", t), re.compile(" " + ls.pattern(ls.parse(t)))
        for _ in range(5):
            words = [rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(rng.randint(0, 14))]
            line = b" " + b" ".join(words) + b" "
            found = any(auto.match(words, at) is not None for at in ls.places(line, auto.lead))
            assert found == bool(rule.search(line.decode())), (t, words)
            hits += found
    assert hits > 100


def test_replaceable_and_optional_regions():
    assert labels_of(f"MIT License\nCopyright (c) 2020 A. Nobody\n\n{MIT}".replace("SHALL", "SHALL the authors or copyright holders")) == "mit"
    assert labels_of(MIT) == "mit"
    assert labels_of(MIT.replace("(including the next paragraph)", "")) == "mit"
    assert labels_of(MIT.replace("without restriction", "with restriction")) == ""
    assert labels_of(MIT.replace("SHALL", "SHALL " + "x " * 13)) == ""
    assert labels_of("licensed under a CC BY-NC 4.0 licence; licensed under CC BY 4.0") == "cc-by-4.0,cc-by-nc-4.0"
    assert labels_of("licensed under CC BY ND 4.0") == ""


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for p, label in ls.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_odd_rows(spark):
    long = "word " * 400_000 + "MIT license, cc by. Released under the MIT License"
    texts = [None, "", " \n", "cc by", "CC-BY cc_by cc by", "CCBY", "mit License mit license", "é mit\xa0license", "éMIT license", "mit license", "gnu general public licenses", "the GNU General Public License, Apache License", long, "mit license\0cc by", "cc by", "cc by"]
    docs = spark.createDataFrame([(None if k == 3 else k // 2, t, "old", 1, 2) for k, t in enumerate(texts)], SCHEMA)
    got = ls.scan_licenses(docs)
    assert [c for c in got.columns if c in docs.columns] == ["doc_id", "text", "n_chars", "labels"]
    rows = got.collect()
    assert sorted((repr(r.text), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == sorted((repr(t), *plain(t)) for t in texts)
    for r in rows:
        assert 0 <= r.score <= 1 and (r.score == 0) == (r.n_base == 0 and not r.spans) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    last = next(r for r in rows if r.text == long)
    assert [tuple(s) for s in last.spans] == [("mit", 400_004, 400_009)] and last.score == 1.0
    assert ls.scan_licenses(docs.limit(0)).collect() == []


def test_whole_table_by_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(repr((r.doc_id, *plain(r.text))) for r in docs.collect())
    got = ls.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
    assert any(r.labels != r.base_labels for r in got)
