"""Operators for training corpora against brute force, round trips and edge cases."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldwave.llm import chat, components, decontaminate, exact_dedup, line_dedup, mixing, near_dedup, quality, registry, token_files, url_rules, warc
from fieldwave.llm.shared import written

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, SIZE long, batch int, kept string, leaks string, row int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
SPACED = "A b\tC\x0bd\x0cE\r\nf  g"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 7, 1, "x", "y", 3) for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(1, "Hello World one two three four", "a"), (2, "hello world ONE two three four", "a"), (3, None, None), (4, "", "b"), (5, LONG, "b"), (6, LONG + " tail", None)]
    rows += [(7, "é É\xa0x", "c"), (8, "ÉÉ", "a"), (8, "ÉÉ", "a"), (None, "nobody knows this text at all", "b"), (None, None, None), (9, SPACED, "zz")]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- SQL
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.SQL[name])
    cols = [c[0] for c in want.description]
    want = sorted(map(repr, want.fetchall()))
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == want


def test_registry_names_each_operator_once():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES) == list(range(1, 14))


# ---------------------------------------------------------------- 1 decontamination
def test_wand_finds_what_brute_force_finds():
    rng = np.random.default_rng(3)
    vocab = [f"t{i}".encode() for i in range(300)]
    zipf = 1 / np.arange(1, 301)
    items = [(i, b" ".join(rng.choice(vocab, rng.integers(8, 150), p=zipf / zipf.sum())).decode()) for i in range(300)]
    index = decontaminate.ItemIndex(items)
    for _ in range(60):
        words = decontaminate.words_of(" ".join([items[rng.integers(300)][1], *[w.decode() for w in rng.choice(vocab, 40)]]))
        for p in range(max(0, -(-(len(words) - 128) // 64)) + 1):
            part = words[p * 64 : p * 64 + 128]
            score = Counter()
            for w in set(part) & set(index.terms):
                ids, shares, *_ = index.postings[index.terms[w]]
                for u, s in zip(ids, shares):
                    score[u] += s
            want = {u for u, s in score.items() if s >= index.threshold - 1e-9}
            assert {u for u, _ in index.wand(part)} == want
            assert not want or p in index.promising(words)


def test_leaks_are_caught_and_clean_texts_left(spark, none):
    q = "Which river of the old northern kingdom flows twice around its capital before it meets the cold sea?"
    items = spark.createDataFrame([(1, q + " The answer is the winding Ember river."), (2, None), (3, ""), (4, "too short"), (None, q), (5, LONG[:3000])], "item_id long, text string")
    filler = " ".join(f"plain{i}" for i in range(300))
    rows = [(1, f"{filler} {q.upper()} the answer is, the winding ember RIVER! {filler}", "a"), (2, filler, "a"), (3, None, "a"), (4, f"{q} nothing like it follows here in this text", "a"), (5, "x " + LONG, "a"), (6, "", None)]
    docs = docs_of(spark, rows)
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.leak_pairs(docs, items))}
    assert got == {(1, 1), (5, 5), (1, None), (4, None)}
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in rows_of(clean)) == [2, 3, 6]
    assert rows_of(decontaminate.leak_pairs(none, items)) == []
    assert rows_of(decontaminate.leak_pairs(docs, items.limit(0))) == []


def test_blocks_of_items_are_indexed_one_at_a_time(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    live, most = set(), []
    context = type(spark.sparkContext)
    make = context.broadcast

    def counted(self, value):
        made = make(self, value)
        live.add(id(made))
        most.append(len(live))
        end = made.destroy
        made.destroy = lambda *a: (live.discard(id(made)), end(*a))
        return made

    monkeypatch.setattr(context, "broadcast", counted)
    got = decontaminate.leak_pairs(docs, items, max_chars=2000).collect()
    assert len(most) > 3 and max(most) == 1 and not live
    want = registry.QUERIES["op1_bm25_wand"](spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(r.doc_id, r.item_id) for r in want}


def test_scores_do_not_depend_on_blocks(spark):
    """Passages with one changed word, so that scores lie everywhere above the limit: equal for every size of the blocks, and by plain counting."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [(r.item_id, r.text) for r in items.collect()]
    rows = []
    for i, t in texts:
        words = t.split()
        rows += [(1000 * i + k, " ".join(["before", *words[:k], "changed", *words[k + 1 :], "after"]), "a") for k in range(0, len(words), 5)]
    docs = docs_of(spark, rows)
    found = [sorted(map(tuple, decontaminate.leak_pairs(docs, items, max_chars=n).collect())) for n in (16_000_000, 3000)]
    assert found[0] == found[1] and len(found[0]) > 100 and len({r[2] for r in found[0]}) > 50
    stats = decontaminate.Statistics.of([t for _, t in texts])
    units = [decontaminate.words_of(t)[k : k + 64] for _, t in texts for k in range(0, len(decontaminate.words_of(t)), 64)]
    assert stats.n == len(units) and stats.mean == sum(map(len, units)) / len(units) and all(stats.df[w] == sum(w in u for u in units) for u in units[:5] for w in u)


def test_a_long_item_is_verified_once_per_stretch(monkeypatch):
    words = [f"v{i}" for i in range(6000)]
    index = decontaminate.ItemIndex([("long", " ".join(words)), ("other", " ".join(f"o{i}" for i in range(40)))])
    seen = []
    plain = decontaminate.shingles
    monkeypatch.setattr(decontaminate, "shingles", lambda w, n=5: seen.append(len(w)) or plain(w, n))
    text = " ".join(["x"] * 20_000 + words + ["y"] * 20_000 + words[:5000] + [f"o{i}" for i in range(40)])
    assert [(x["item_id"], x["question_overlap"], x["answer_overlap"]) for x in index.leaks(text, 0.75, 0.5, 0.75)] == [("long", 1.0, 1.0), ("other", 1.0, 1.0)]
    assert sum(seen) < 2.5 * len(text.split())


def test_short_and_nameless_items_are_found(spark):
    items = spark.createDataFrame([("a", "Zanzibar quagga"), (None, "vermilion okapi"), ("long", LONG[:900]), ("b", "")], "item_id string, text string")
    docs = docs_of(spark, [(1, "so the ZANZIBAR, quagga ran", "a"), (2, "quagga zanzibar", "a"), (3, "a vermilion okapi " + LONG[:900], "a"), (4, "okapi", "a"), (4, "vermilion okapi", "a")])
    for most in (16_000_000, 250):
        got = Counter((r.doc_id, r.item_id) for r in decontaminate.leak_pairs(docs, items, max_chars=most).collect())
        assert got == Counter([(1, "a"), (3, None), (3, "long"), (4, None)])
    assert decontaminate.clean_documents(docs, items, max_chars=250).columns == docs.columns


def test_decontamination_by_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    inside = lambda s, near: sum(x in near for x in s) / len(s)
    parts = [(r.item_id, *map(decontaminate.shingles, decontaminate.split_item(r.text))) for r in items.collect()]
    want = set()
    for r in docs.collect():
        near = decontaminate.shingles(decontaminate.words_of(r.text))
        want |= {(r.doc_id, i) for i, q, a in parts if inside(q, near) >= 0.75 and inside(a, near) >= 0.5}
    got = registry.QUERIES["op1_bm25_wand"](spark, SF).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want


def test_near_copies_with_an_edited_answer_are_leaks(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items.append((-1, "seven short words make this whole item"))
    inside = lambda s, near: sum(x in near for x in s) / len(s)
    filler, rows, want, lost = " ".join(f"plain{i}" for i in range(80)), [], set(), 0
    for i, t in items:
        q, a = decontaminate.split_item(t)
        if len(q + a) < 5:
            continue
        s, of_q, of_a = map(decontaminate.shingles, (q + a, q, a))
        for k in range(len(a)):
            words = [w.decode() for w in q + a[:k] + [b"changed"] + a[k + 1 :]]
            rows.append((len(rows), f"{filler} {' '.join(words)} {filler}", "a"))
            near = decontaminate.shingles(decontaminate.words_of(rows[-1][1]))
            two = bool(of_q) and inside(of_q, near) >= 0.75 and inside(of_a, near) >= 0.5
            if two or inside(s, near) >= 0.75:
                want.add((rows[-1][0], i))
                lost += not two
    rows.append((len(rows), f"{filler} {items[-1][1]} {filler}", "a"))
    want.add((rows[-1][0], -1))
    made = decontaminate.leak_pairs(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in made.collect()}
    assert lost and want <= got
    near = {r[0]: decontaminate.shingles(decontaminate.words_of(r[1])) for r in rows}
    parts = {i: [decontaminate.shingles(p) for p in (sum(decontaminate.split_item(t), []), *decontaminate.split_item(t))] for i, t in items}
    assert all(inside(parts[i][0], near[d]) >= 0.75 or inside(parts[i][1], near[d]) >= 0.75 and inside(parts[i][2], near[d]) >= 0.5 for d, i in got - want)


# ---------------------------------------------------------------- 2 WARC
def test_warc_round_trip(spark):
    body = "<p>" + "same words " * 200
    rows = [(1, "http://a/\r\nX: y", body), (2, "http://b", body), (3, None, None), (4, "http://c", ""), (5, "http://d", "short"), (6, "http://e", "short"), (None, "http://f", body), (7, "http://g", "É" * 600), (7, "http://g", "É" * 600), (8, "http://h", LONG * 3)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string")
    index = warc.write_warc(pages, file_bytes=20_000)
    back = warc.read_warc(index).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in back) == Counter((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert {(r.page_id, r.record_type, r.refers_to) for r in back} == {(1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (None, "revisit", 2), (7, "response", None), (8, "response", None)}
    assert {bytes(r.body).decode() for r in back if r.page_id == 8} == {LONG * 3}
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_warc_keeps_every_payload_and_id(spark):
    a, b, c = ("<p>" + w * 1200 for w in "abc")
    big = 2**60
    rows = [(9, "u", a), (5, "u", a), (5, "u", b), (4, "u", b), (4, "u", c), (3, "u", c), (big + 1, "u", "x" * 2000), (big + 3, "u", "x" * 2000), (None, "u", "y" * 3000), (None, "u", "y" * 3000), (2, "u", a), (2, "u", a)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = warc.read_warc(warc.write_warc(pages)).collect()
    assert Counter((r.page_id, r.payload_digest) for r in back) == Counter((i, hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows)
    name = {hashlib.sha1(h.encode()).hexdigest(): k for k, h in (("a", a), ("b", b), ("c", c), ("x", "x" * 2000), ("y", "y" * 3000))}
    got = Counter((r.page_id, name[r.payload_digest], r.record_type, r.refers_to) for r in back)
    assert got == Counter([(9, "a", "response", None), (5, "a", "revisit", 9), (5, "b", "response", None), (4, "b", "revisit", 5), (4, "c", "response", None), (3, "c", "revisit", 4), (big + 1, "x", "revisit", big + 3), (big + 3, "x", "response", None), (None, "y", "response", None), (None, "y", "response", None), (2, "a", "revisit", 9), (2, "a", "revisit", 9)])
    assert {bytes(r.body).decode() for r in back if r.record_type == "response"} == {h for _, _, h in rows}


def test_warc_ids_are_told_apart_and_revisits_name_the_very_record(spark):
    """Repeated and null page ids, equal rows, several payloads of one page; by broadcast and by shuffle."""
    a, b, c = ("<p>" + w * 1200 for w in "abc")
    rows = [(5, "u", a), (5, "u", a), (5, "v", b), (2, "u", a), (None, "u", a), (None, "u", a), (3, "u", b), (None, "x", "short"), (None, "x", "short"), (7, "u", c), (7, "u", "short"), (None, "u", "z" * 2000), (None, "u", "z" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for most in (500_000, 0):
        back = warc.read_warc(warc.write_warc(pages, most=most)).collect()
        assert len({r.record_id for r in back}) == len(back) == len(rows)
        held = {r.record_id: r for r in back}
        for r in back:
            assert (r.refers_id is None) == (r.record_type == "response")
            if r.refers_id:
                to = held[r.refers_id]
                assert (to.record_type, to.page_id, to.payload_digest) == ("response", r.refers_to, r.payload_digest)
        assert Counter(r.record_type for r in back) == {"revisit": 4, "response": 9}


def test_a_hot_payload_and_pages_without_ids_are_spread(spark):
    """Nearly all pages hold one payload, or have no id: no task archives them all, and no record is lost."""
    body = "<p>" + "hot " * 400
    rows = [(i, "u", body) for i in range(900)] + [(None, f"n{i}", "short") for i in range(900)] + [(None, f"m{i}", body) for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    for most in (500_000, 0):
        index = warc.write_warc(pages, most=most)
        per_file = [r["count"] for r in index.groupBy("file").count().collect()]
        assert sum(per_file) == len(rows) and max(per_file) < len(rows) / 2
        back = warc.read_warc(index).groupBy("record_type", "refers_to").count().collect()
        assert Counter({(r.record_type, r.refers_to): r["count"] for r in back}) == {("revisit", 899): 999, ("response", None): 901}


def test_warc_record_is_readable_by_its_offset(spark):
    import zstandard

    index = warc.write_warc(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    r = index[len(index) // 2]
    raw = open(r.file.removeprefix("file://"), "rb").read()
    size = int.from_bytes(raw[4:8], "little")
    assert int.from_bytes(raw[:4], "little") == warc.DICT_FRAME and size > 0
    frame = raw[r.offset : r.offset + r.length]
    text = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj().decompress(frame)
    assert f"X-Page-Id: {r.page_id}\r\n".encode() in text


# ---------------------------------------------------------------- 3 line dedup
def brute_lines(rows, least):
    key = lambda x: re.sub(r"[A-Z]+", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    found = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            found[key(x)].add(i)
    hot = {k for k, ids in found.items() if k and len(ids) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fan_in,most", [(1, 2, 1000), (5, 2, 0), (7, 3, 1000)])
def test_line_dedup(spark, batches, fan_in, most):
    rng = np.random.default_rng(1)
    rows = [(i, "\n".join([" Common LINE\t", "", f"own {i}", *(f"Line {k}" for k in rng.integers(0, 12, 5))])) for i in range(25)]
    rows += [(100, None), (101, ""), (102, "common line"), (102, "common line"), (None, "É common\ncommon line"), (103, "a\rb\n\x0b\n \xa0 "), (104, LONG), (2**60 + 1, "line 1"), (2**60 + 3, "line 2")]
    docs = docs_of(spark, [(i, t, "a") for i, t in rows])
    got = line_dedup.line_dedup(docs, min_docs=10, n_batches=batches, fan_in=fan_in, max_broadcast=most)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lines(rows, 10)


def test_runs_are_merged_without_moving_or_sorting_them(spark):
    runs = line_dedup.LineRuns(spark, 10, 4)
    lines = spark.range(3000).select(F.col("id").alias("doc_id"), F.unhex(F.md5((F.col("id") % 500).cast("string"))).alias("key"))
    for k in range(3):
        runs.add(lines.where(F.col("doc_id") % 3 == k))
    assert len(runs.levels[0]) == 3 and len(runs.frequent) == 3
    with line_dedup.run_settings(spark):
        for rows in (runs.merged(runs.levels[0]), runs.against_runs(runs._run(runs.counted(lines), "line_batch"))):
            rows.collect()
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and not re.search(r"Exchange|\bSort\b", plan)
    assert runs.complete().count() == 0


def test_line_dedup_empty(spark, none):
    assert line_dedup.line_dedup(none).count() == 0


# ---------------------------------------------------------------- 4 chat
def test_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "open", "user", None), (1, 1, 0, "delta", None, "hel"), (1, 2, 0, "delta", None, "lo"), (1, 3, 1, "open", "assistant", None), (1, 4, 1, "delta", None, "bad"),
        (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "go"), (1, 7, 1, "delta", None, "od"), (1, 8, 0, "edit", None, "hi"), (1, 9, 2, "open", "user", None), (1, 10, 2, "retract", None, None),
        (None, 0, 0, "delta", "user", "loose"), (2, 0, 0, "open", None, None),
    ]
    got = chat.fold_events(spark.createDataFrame(log, "conv_id long, seq long, turn long, op string, role string, text string"))
    assert {tuple(r) for r in got.collect()} == {(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (None, 0, "user", "loose"), (2, 0, None, "")}


def test_logs_with_ties_unknown_ops_and_long_conversations(spark):
    log = [(1, 0, 0, "open", "user", None), (1, 0, 0, "delta", None, "b"), (1, 0, 0, "delta", None, "a"), (1, 1, 0, "typo", "robot", "x"), (1, 1, 0, None, "robot", "y"), (1, 2, 1, "typo", "user", "z"), (1, None, 0, "delta", None, "lost")]
    log += [(2, t * 10, t, "open", "assistant", None) for t in range(3000)] + [(2, t * 10 + k, t, "delta", None, f"{t}.{k} ") for t in range(3000) for k in (1, 2)]
    log += [(3, 5, 0, "edit", "user", "late"), (3, 5, 0, "regenerate", "user", None), (4, 1, 0, "open", "user", None), (4, 2, 0, "delta", None, "gone"), (4, 3, 0, "retract", None, None), (4, 4, 0, "edit", None, "back")]
    events = spark.createDataFrame(log, "conv_id long, seq long, turn long, op string, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(events))).collect()}
    assert [(t["role"], t["text"]) for t in got[1].turns] == [("user", "ab")]
    assert got[2].learned == "".join(f"{t}.1 {t}.2 " for t in range(3000)) and len(got[2].turns) == 3000
    assert [(t["role"], t["text"]) for t in got[3].turns] == [("user", "late")] and [t["text"] for t in got[4].turns] == ["back"]


def test_chat_escapes_round_trip(spark):
    texts = ["", None, "\\", "\\\\<|", "<|im_end|>\n<|im_start|>user\nx", "<\\|", "a\\n<", "<|im_end|><|im_start|>assistant ok", "É😀\\|<<||>>", "x" * 5000 + "\\<|\n"]
    rows = [(c, t, r, x, 1) for c in (1, None) for t, (r, x) in enumerate((r, x) for x in texts for r in ("user", "assistant", None, "ro\nle\\n<|"))]
    rows += [(3, None, "assistant", "no turn", 1), (3, 0, "assistant", "same", 1), (3, 0, "assistant", "same", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(chat.message_events(table, chunk=3)))).collect()}
    for conv in (1, None, 3):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        said = [(a["role"], a["text"]) for a in back[conv].turns]
        if conv != 3:  # null roles sort with their column, so compare turns as sets within a turn
            assert sorted(said) == sorted((r, x) for _, r, x in own)
        else:
            assert said == [(r, x) for _, r, x in own]
        assert back[conv].learned == "".join(x for r, x in said if r == "assistant")
    assert chat.render(chat.fold_events(chat.message_events(table.limit(0)))).count() == 0


# ---------------------------------------------------------------- 5 near-dedup
def brute_near(rows):
    sets = []
    for _, t in rows:
        w = re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode()).split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[root(i)].append(rows[i][0])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((rows[i][0], len(sets[i]), name[root(i)]) for i in range(len(rows))), key=repr), len(least)


def edited(rng, words, n):
    words = list(words)
    for k in rng.choice(len(words), n, replace=False):
        words[k] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def test_near_dedup_by_brute_force(spark):
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(160)]
    rows = [(1000 - i, edited(rng, base, int(k))) for i, k in enumerate(rng.integers(0, 12, 150))]
    for i in range(120):
        words = [f"x{i}y{rng.integers(1 << 20)}" for _ in range(int(rng.integers(1, 60)))]
        rows.append((2000 + 2 * i, " ".join(words)))
        rows.append((2001 + 2 * i, edited(rng, words, min(len(words), int(rng.integers(0, 3))))))
    rows += [(1, "Same Words HERE"), (2, "same words here"), (2, "same  words\nhere"), (3, None), (4, ""), (5, " \t"), (None, "same words here"), (None, "alone in the dark today"), (6, LONG), (7, LONG + " end"), (8, "É é"), (9, "é É")]
    got = near_dedup.near_dedup(docs_of(spark, [(i, t, "a") for i, t in rows])).collect()
    want, groups = brute_near(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id not in (2, None))


def test_full_sets_of_an_id_at_the_filter_s_first_spot(spark):
    words = [f"z{i}" for i in range(200)]
    rows = [(25317696, " ".join(words)), (25317697, " ".join([*words[:-1], "end"])), (3, "some text that is like no other one")]
    docs = docs_of(spark, [(i, t, "a") for i, t in rows])
    assert docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(near_dedup._FILTER_BITS))).first()[0] == 0
    got = near_dedup.near_dedup(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (25317696, 25317696), (25317697, 25317696)]


def test_near_dedup_edges(spark, none, odd):
    assert near_dedup.near_dedup(none).count() == 0
    got = near_dedup.near_dedup(odd)
    assert got.count() == odd.count()
    one = docs_of(spark, [(4, "a b c d e f g", "s"), (2, "A b c d e f g", "s"), (9, "other text entirely here now", "s")])
    kept = near_dedup.without_near_duplicates(one)
    assert kept.columns == one.columns and sorted(r.doc_id for r in kept.collect()) == [2, 9]


def test_repeated_null_and_large_ids_survive_dedup(spark):
    big = 2**60
    text = lambda k: f"this text number {k} is told apart by its own words w{k} x{k}"
    rows = [(2, text(1), "a"), (2, text(1), "a"), (2, text(2), "a"), (None, text(3), "a"), (None, text(3), "b"), (None, text(4), "a"), (big + 1, text(5), "a"), (big + 3, text(5), "a"), (big + 5, text(6), "a")]
    docs = docs_of(spark, rows).coalesce(1)
    got = near_dedup.near_dedup(docs).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(2, 2), (2, 2), (2, 2), (None, None), (None, None), (None, None), (big + 1, big + 1), (big + 3, big + 1), (big + 5, big + 5)])
    for kept in (near_dedup.without_near_duplicates(docs), near_dedup.without_near_duplicates(docs, max_broadcast=0), exact_dedup.kept_documents(docs, keep="smallest")):
        assert kept.columns == docs.columns
        assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(i), text(k)) for i, k in ((2, 1), (2, 2), (None, 3), (None, 4), (big + 1, 5), (big + 5, 6)))


def test_tiles_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_TILE", 8)
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(120)]
    other = base[:62] + [f"c{i}" for i in range(58)]
    rows = [(i, edited(rng, base if i % 3 else other, int(rng.integers(0, 9)))) for i in range(150)]
    got = near_dedup.near_dedup(docs_of(spark, [(i, t, "a") for i, t in rows])).collect()
    want, groups = brute_near(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want and groups > 1


def test_recall_of_links_of_every_tenth_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: set(near_dedup.shingle_set(r.text).tolist()) for r in docs}
    links = [(q, i) for q in sets if q % 10 == 0 for i in sets if i != q and sets[q] and 100 * len(sets[q] & sets[i]) >= 75 * len(sets[q] | sets[i])]
    group = {r.doc_id: r.component_id for r in registry.QUERIES["op5_hyperminhash"](spark, "/root/testdata/sf0.01").collect()}
    assert len(links) > 3 and all(group[a] == group[b] for a, b in links)


def test_estimates_are_close():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.75, 0.9):
        off = []
        for _ in range(30):
            n = 400
            common = int(2 * n * share / (1 + share))
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[:common], rng.integers(0, 1 << 63, n - common, dtype=np.uint64)])
            mix = near_dedup._mix
            off.append(near_dedup.estimate(near_dedup.sketch(np.unique(mix(a))), near_dedup.sketch(np.unique(mix(b)))) - common / (2 * n - common))
        assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.06


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


# ---------------------------------------------------------------- 6 tokens
def test_codes_address_every_token():
    rng = np.random.default_rng(0)
    ids = (2 ** rng.integers(0, 31, 5000)).astype(np.uint32) - rng.integers(0, 2, 5000).astype(np.uint32)
    f = token_files.TokenFile(token_files.pack_file([1, None], [2000, 3000], ids))
    assert [f.token(i) for i in range(5000)] == ids.tolist()
    for a, b in [(0, 5000), (7, 7), (3, 4), (511, 513), (1000, 4999), (4000, 5000)]:
        assert (f.tokens(a, b) == ids[a:b]).all()


def test_words_encode_as_whole_texts_do(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", None, " a  b,\n c. d.. 3, 4.5 x,.\t y's don't <|endoftext|> <|startoftext|>a <|endoftext|>, É́ É. İ ΑΣ, ΑΣ\x1c!\x1c! \xa0z q."]
    texts += ["a" * 5000 + " " + "b," * 3000, "foo'S, 'S. ' s, 𝟜, Ⅷ. ½, ・.", "ſ ﬁ, K. ́, x́, \r\nA\x85b \u2028", SPACED, LONG[:20_000]]
    enc = token_files.WordEncoder(path, most=500)
    for _ in range(2):
        for text, raw in zip(texts, enc.batch(texts)):
            assert np.frombuffer(raw, enc.kind).tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_added_tokens_are_matched_with_case():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, enc = Tokenizer.from_file(path), token_files.WordEncoder(path)
    texts = ["a <|EndOfText|> b", "<|STARTOFTEXT|>", "x<|EndOfText|>Y, <|endoftext|> Z<|endoftext|>Q.", "Plain WORDS stay"]
    for text, raw in zip(texts, enc.batch(texts)):
        assert np.frombuffer(raw, enc.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files_by_brute_force(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    back = token_files.read_tokens(token_files.write_tokens(odd, path, file_tokens=3000))
    got = back.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_digests(none).count() == 0


def test_token_files_keep_large_and_repeated_ids(spark):
    rows = [(2**60 + k, f"text {k}", "a") for k in (3, 1)] + [(None, f"n{i} words", "a") for i in range(50)] + [(7, f"t{i} words", "a") for i in range(50)] + [(8, "same", "a")] * 20
    docs = docs_of(spark, rows).coalesce(1)
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_tokens(docs, path, file_tokens=40)
    got = token_files.read_tokens(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert len({r.part for r in manifest.collect()}) > 2


def test_pieces_are_bounded():
    assert list(token_files.pieces([])) == [] and list(token_files.pieces([5, 9, 1, 1, 20, 2], 10)) == [(0, 1), (1, 3), (3, 4), (4, 5), (5, 6)]


def test_other_vocabularies_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, texts = token_files.WordEncoder(path), ["Hello  world\n\n x", None, "", "a b"]
    assert not enc.by_words
    library = Tokenizer.from_file(path)
    for text, raw in zip(texts, enc.batch(texts)):
        assert np.frombuffer(raw, enc.kind).tolist() == library.encode(text or "", add_special_tokens=False).ids


# ---------------------------------------------------------------- 7 exact dedup
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, odd, none, keep):
    many = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100)).repartition(7)
    rows = [(r.doc_id, (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for r in many.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    pick = (lambda ids: max((i for i in ids if i is not None), default=None)) if keep == "largest" else (lambda ids: None if None in ids else min(ids))
    want = sorted(((i, pick(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=repr)
    got = exact_dedup.exact_dedup(many, keep=keep, fan_in=2).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_runs_are_cut_by_rows_and_merged_in_rounds(spark):
    """The registered query merges: its plan holds an exchange and a sort of digests per round; hot texts and any number of runs give the same."""
    plan = exact_dedup.query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("prefix") >= 4 and plan.count("RepartitionByExpression") >= 2
    docs = docs_of(spark, [(i, "hot TEXT" if i % 4 else f"own {i % 40}", "a") for i in range(400)])
    want = sorted(map(repr, map(tuple, exact_dedup.exact_dedup(docs, min_runs=1).drop("row").collect())))
    for options in ({"run_rows": 10}, {"min_runs": 3, "fan_in": 2}, {"run_rows": 40, "fan_in": 3}):
        assert sorted(map(repr, map(tuple, exact_dedup.exact_dedup(docs, **options).drop("row").collect()))) == want
    runs = exact_dedup.digest_runs(docs, 40).groupBy("run").count().collect()
    assert len(runs) == 40 and max(r["count"] for r in runs) < 40


# ---------------------------------------------------------------- 8 url filter
def test_urls_hosts_and_paths(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/71?x#y", "a://b://c/d", "http://x.example.com/en/8#f", "https://example.net/de/85", "https://u.net/de/", "ftp://org/es/1", "x://notorg/es/1", "http://h?q=/en/", "http://É.com/En/"]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, VERDICT string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_rules.url_filter(pages, labels).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/71", "example.com/en/7", "allow"), ("b:", "//c/d", None, "allow"),
        ("x.example.com", "/en/8", "com/en/", "block"), ("example.net", "/de/85", "example.net/de/8", "block"), ("u.net", "/de/", "net/de/", "allow"), ("org", "/es/1", "org/es/", "block"), ("notorg", "/es/1", None, "allow"), ("h", "", None, "allow"), ("É.com", "/En/", None, "allow"),
    ]
    assert url_rules.url_filter(pages.limit(0), labels).count() == 0


def test_rules_are_mined_and_matched(spark):
    rows = [(i, f"http://{'casino' if i % 3 == 0 else 'news'}.site/{'win' if i % 2 else 'read'}?page={i}") for i in range(300)]
    pages = spark.createDataFrame([*rows, (900, "http://casino.site/win"), (901, "http://casino.site/read"), (901, "http://casino.site/read")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 and i % 2 else 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.url_filter(pages, labels).collect()}
    assert all(got[i] == ("block" if i % 3 == 0 and i % 2 else "allow") for i in range(300))
    assert got[900] == "block" and got[901] == "allow"


def test_bad_hosts_are_named_by_rules(spark):
    rows, bad = [], set()
    for i in range(400):
        name = ("casino-win", "www.free-bets", "news", "m.blog")[i % 4]
        rows.append((i, f"http://{name}.example.com/en/{i}"))
        bad |= {i} if i % 4 < 2 else set()
    for i in range(400, 500):
        rows.append((i, f"http://{'pills' if i % 2 else 'garden'}.co.uk/{i}"))
        bad |= {i} if i % 2 else set()
    new = ["http://m.casino-win.example.com/x", "http://free-bets.example.com/x", "http://a.pills.co.uk/", "http://news.example.com/x", "http://garden.co.uk/x"]
    pages = spark.createDataFrame([*rows, *((900 + k, u) for k, u in enumerate(new))], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i in bad else 1, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.url_filter(pages, labels, rules=()).collect()}
    assert all(got[i] == ("block" if i in bad else "allow") for i in range(500))
    assert [got[900 + k] for k in range(5)] == ["block", "block", "block", "allow", "allow"]


def test_rules_are_not_pushed_out_by_wider_ones(spark):
    deep = "/".join(f"p{k}" for k in range(13))
    rows = [(i, f"http://a{i}/{deep}/{i}", True) for i in range(30)] + [(100 + i, f"http://b{i}/low/{i}", i % 10 < 7) for i in range(100)] + [(300 + i, f"http://c{i}/x/y/{i}" if i < 40 else f"http://c{i}/{'xy'[i % 2]}/{i}", i < 40) for i in range(140)]
    tokens = spark.createDataFrame(rows, "i long, url string, block boolean").select(url_rules.url_tokens(F.col("url")).alias("tokens"), "block")
    rules = {tuple(sorted(r.antecedent)): (round(r.confidence, 6), r.anchor) for r in url_rules.mine_rules(tokens).collect()}
    want = {(f"path=p{k}",): (1.0, f"path=p{k}") for k in range(13)} | {("path=low",): (0.7, "path=low"), ("path=x", "path=y"): (1.0, "path=x")}
    assert rules == want


def brute_rules(pages, least, confidence):
    """All minimal token sets with enough blocked pages and confidence: {tokens: confidence}."""
    hits = Counter(t for tokens, bad in pages if bad for t in tokens)
    sets = {s for tokens, bad in pages if bad for own in [sorted(t for t in tokens if hits[t] >= least)] for k in range(1, len(own) + 1) for s in itertools.combinations(own, k)}
    good = {}
    for s in sorted(sets, key=len):
        on = [bad for tokens, bad in pages if set(s) <= tokens]
        if sum(on) >= least and sum(on) >= confidence * len(on) and not any(set(t) < set(s) for t in good):
            good[s] = sum(on) / len(on)
    return good


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(300):
        tokens = {f"t{k}" for k in range(9) if rng.random() < 0.45} | ({"u", "v"} if rng.random() < 0.2 else set())
        rows.append((sorted(tokens), bool(rng.random() < 0.25 + 0.5 * ({"t1", "t4"} <= tokens) + 0.4 * ({"u", "t2", "t3"} <= tokens))))
    got = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, block boolean"), min_support=0.0, min_count=8)
    got = {tuple(sorted(r.antecedent)): round(r.confidence, 9) for r in got.collect()}
    want = {s: round(c, 9) for s, c in brute_rules([(set(t), b) for t, b in rows], 8, 0.6).items()}
    assert len(want) > 3 and got == want


def test_alike_tokens_are_not_multiplied_out(spark):
    """Three groups of thirty tokens that only together mean block are one rule, not 27,000; many groups that are rules alone stay linear."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        on = [bool(rng.random() < 0.5) for _ in range(3)]
        rows.append(([f"g{k}x{j}" for k in range(3) if on[k] for j in range(30)], all(on)))
    for k in range(20):
        rows += [([f"h{k}y{j}" for j in range(30)], True)] * 25
    groups = url_rules.mine_groups(spark.createDataFrame(rows, "tokens array<string>, block boolean")).collect()
    wide = [r for r in groups if len(r.groups) > 1]
    assert len(wide) == 1 and sorted(map(len, wide[0].groups)) == [30, 30, 30] and len(wide[0].anchors) == 30 and wide[0].confidence == 1.0
    assert len(groups) == 1 + 20 * 30
    rule = spark.createDataFrame([([["path=a", "path=b"], ["path=c", "path=d"]], ["path=c", "path=d"], 0.8)], "groups array<array<string>>, anchors array<string>, confidence double")
    urls = spark.createDataFrame([(f"http://x/{p}",) for p in ("a/c", "b/d", "a/b", "c/d", "d/e/a")], "url string")
    for most in (100, 0):
        assert {r.url for r in url_rules.match_rules(urls, rule, max_broadcast=most).collect()} == {"http://x/a/c", "http://x/b/d", "http://x/d/e/a"}


def test_verdicts_by_brute_force(spark):
    pages, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "labels"))
    bad = {r.doc_id: r.quality == 0 or r.toxic == 1 for r in labels.collect()}
    rows = pages.select("page_id", "url", url_rules.url_tokens(F.col("url")).alias("tokens")).collect()
    known = [(set(r.tokens), bad[r.page_id]) for r in rows if r.page_id in bad]
    options = {"min_count": 4, "min_confidence": 0.3, "min_support": 0.0}
    rules = brute_rules(known, 4, 0.3)
    want = {r.page_id: max((c for s, c in rules.items() if set(s) <= set(r.tokens)), default=None) for r in rows}
    got = {r.page_id: r for r in url_rules.url_filter(pages, labels, rules=(), **options).collect()}
    assert rules and all(got[i].verdict == ("allow" if c is None else "block") and (c is None or abs(got[i].confidence - c) < 1e-9) for i, c in want.items())


def test_many_rules_meet_urls_by_shuffle(spark):
    urls = spark.createDataFrame([(None,), ("http://a.com/x",), ("http://a.com/y",), ("http://b.com/x",)], "url string")
    rules = spark.createDataFrame([(["host=a.com", "path=x"], 0.9, 0.1, "path=x"), (["path=x"], 0.7, 0.1, "path=x")], "antecedent array<string>, confidence double, support double, anchor string")
    for most in (0, 100):
        got = {r.url: r.confidence for r in url_rules.match_rules(urls, rules, max_broadcast=most).collect()}
        assert got == {"http://a.com/x": 0.9, "http://b.com/x": 0.7}


def test_long_urls_with_one_path_are_mined(spark):
    deep = "/".join(f"p{k}" for k in range(60))
    rows = [(i, f"http://h{i}/{deep}/{i}") for i in range(80)] + [(100 + i, f"http://k{i}/else/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 40 else 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.url_filter(pages, labels, min_confidence=0.5).collect()}
    assert {i for i, v in got.items() if v == "block"} == set(range(80))


# ---------------------------------------------------------------- 9 mixing
def test_mixing_targets_and_budgets(spark, odd, none):
    got = rows_of(mixing.mix_sources(odd))
    assert len(got) == odd.count()
    assert set(odd.columns) - {"SIZE"} <= set(got[0])
    by = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1
    for v in by.values():
        assert sum(r["taken"] for r in v) == int(v[0]["target"]) and v[0]["source_size"] == sum(r["size"] for r in v)
    again = rows_of(mixing.mix_sources(odd.repartition(3)))
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_targets_stop_and_reshare(spark):
    sizes = spark.createDataFrame([("sa", 1000), ("sb", 10), ("sc", 10), ("z", 0)], "_src string, source_size long")
    got = {r._src: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["sb"] == 30 and got["sc"] == 30 and got["z"] == 0 and abs(got["sa"] - 960) < 1e-6


def test_mixed_documents_repeat_whole_documents(spark):
    docs = docs_of(spark, [(i, "w " * (i + 1), "ab"[i % 2]) for i in range(40)])
    taken = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix_sources(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in taken.items() if v})


def test_native_operators_run_no_python(spark):
    for name in ("op4_chat_events", "op9_mix_prefix_sums"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- 10 quality
def test_quality_learns_and_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(got) > 80 and np.mean([r.predicted == r.quality for r in got]) > 0.95


TEXTS = ["Some plain words of prose, said calmly and said again.", "", "BUY NOW!!! $$$ %%% buy buy", "é ü ß\nand \x0b more words", "x", "word " * 400, None, "ab"]


def brute_forward(model, text):
    """The score of one whole text, token by token."""
    p, raw = model.weights, (text or "").encode()
    ends, rows = quality.passages(raw), []

    def mixed(h, buckets):
        h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
        return (h ^ h >> 12) & (buckets - 1)

    for a, b in zip([0, *ends], ends):
        piece = raw[a:b]
        kinds = [int(quality._TABLE[c]) for c in piece]
        n = max(len(piece), 1)
        x = [np.sqrt(kinds.count(k) / n) for k in range(quality._CLASSES)]
        x.append(np.sqrt(sum(u == v == quality._UPPER for u, v in zip(kinds, kinds[1:])) / n))
        w = piece.split()
        top = max(Counter(w).values()) if w and len(set(w)) * 4 < len(w) else 0
        x += [len(w) / n, len(set(w)) / max(len(w), 1), top / max(len(w), 1), sum(map(len, w)) / max(len(w), 1) / 10, len(set(map(len, w))) / 10, float(not piece)]
        row = list((np.array(x, np.float32) - p["mean"]) / p["std"])
        h = [xxhash.xxh32_intdigest(v) for v in w]
        pairs = [(u * 0x9E3779B1 + v) & 0xFFFFFFFF for u, v in zip(h, h[1:])]
        grams = [(piece[i] | piece[i + 1] << 8 | piece[i + 2] << 16) * 0x85EBCA77 & 0xFFFFFFFF for i in range(len(piece) - 2)]
        for k, own in enumerate((h, pairs, grams)):
            row += list(np.mean([p[f"E{k}"][:, mixed(v, quality._BUCKETS[k])] for v in own], axis=0) if own else np.zeros(quality._WIDTH))
        rows.append(np.tanh(np.array(row) @ p["We"] + p["be"]))
    e = [float((np.tanh(h @ p["Wt"]) / (1 + np.exp(-(h @ p["Ws"])))) @ p["wa"]) for h in rows]
    a = np.exp(e) / np.exp(e).sum()
    return 1 / (1 + np.exp(-(sum(u * h for u, h in zip(a, rows)) @ p["wo"] + p["bo"])))


def test_scores_by_brute_force():
    bags = quality.featurize(TEXTS)
    model = quality.fit(bags, np.array([1, 0, 0, 1, 1, 0, 1, 0.0]), epochs=40, rate=0.05)
    assert np.allclose(model.score(bags), [brute_forward(model, t) for t in TEXTS], atol=1e-5)
    part = bags.take(np.array([5, 2]))
    assert np.allclose(model.score(part), [brute_forward(model, TEXTS[k]) for k in (5, 2)], atol=1e-5)


def test_order_of_words_counts():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    good = [" ".join(words[i] for i in (np.arange(40) + rng.integers(60)) % 60) for _ in range(120)]
    mixed = [" ".join(rng.permutation(t.split())) for t in good]
    y = np.array([1.0] * 120 + [0.0] * 120)
    train = np.r_[0:100, 120:220]
    model = quality.fit(quality.featurize([[*good, *mixed][i] for i in train]), y[train], epochs=30)
    assert np.mean((model.score(quality.featurize(good[100:] + mixed[100:])) >= 0.5) == np.r_[np.ones(20), np.zeros(20)]) > 0.9


def test_gradients():
    rng = np.random.default_rng(1)
    bags, y = quality.featurize(TEXTS[:5]), np.array([0, 1, 1, 0, 1.0])
    model = quality.fit(bags, y, epochs=1)
    model.weights = {k: np.array(v, float) for k, v in model.weights.items()}
    model.weights["wo"] = rng.normal(size=24)
    ids = [int(bags.tokens[k][0][0]) for k in range(3)]

    def loss():
        p = 1 / (1 + np.exp(-model.forward(bags)[0]))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in model.gradients(bags, y).items():
        w = model.weights[name]
        at = (2, ids[int(name[1])]) if name[0] == "E" else (0,) * w.ndim
        old = float(w[at])
        w[at] = old + 1e-4
        up = loss()
        w[at] = old - 1e-4
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-4 - np.asarray(g)[at]) < (1e-4 if name[0] == "E" else 1e-6)


def test_training_is_bounded_by_whole_documents(spark):
    rows = [(i, ("good plain words here " if i % 2 else "junk !!! $$$ ### ") * 200, "a") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    seen = []
    keep = quality.fit
    try:
        quality.fit = lambda bags, y, **k: (seen.append(bags), keep(bags, y, **k))[1]
        got = quality.classify(docs_of(spark, rows), labels, max_bytes=200_000).collect()
    finally:
        quality.fit = keep
    assert 100_000 < sum(n.sum() for _, n in seen[0].tokens[2:]) < 300_000 and min(seen[0].sizes) >= 6
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.98


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows_of(quality.classify(odd, labels))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got if r["doc_id"]} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(1, 10)}
    assert quality.classify(none, labels).count() == 0
    assert all(r["score"] == got0["score"] for got0 in [rows_of(quality.classify(odd, labels.limit(0)))[0]] for r in rows_of(quality.classify(odd, labels.limit(0))))


def test_long_texts_are_scored_whole():
    clean = "Some plain words of prose, said calmly. " * 2000
    bags = quality.featurize([clean, clean + "!!! $$$ %%% " * 2000])
    n = bags.sizes
    assert n[1] > n[0] > 100 and bags.x[n[0] + n[1] - 2][5] > 0.2


# ---------------------------------------------------------------- pipeline
def test_every_stage_takes_odd_rows(spark, odd, none, tmp_path):
    import corpus_pipeline

    docs = odd.drop("SIZE", "batch", "kept", "leaks", "row").withColumn("row_key", F.lit(1)).withColumn("Score", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nobody knows this text at all"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    rows = {name: stage(spark, docs, str(tmp_path)).collect() for name, stage in stages.items()}
    assert all(r.__fields__ == docs.columns for name in list(stages)[:-1] for r in rows[name])
    near = Counter((r.doc_id, r.text) for r in rows["near-duplicates"])
    assert near[(8, "ÉÉ")] == 1 and near[(None, None)] == 1 and sum((i, LONG + x) in near for i, x in ((5, ""), (6, " tail"))) == 1
    assert Counter((r.doc_id, r.text) for r in rows["decontamination"]) == Counter((r.doc_id, r.text) for r in docs.collect() if r.text is None or "nobody" not in r.text)
    assert len(rows["token files"]) == docs.count()
    empty = none.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in stages.items():
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    tables = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, SF), "test")
        assert kept.columns == docs.columns
        tables.append([tuple(r) for r in kept.collect()])
    scored = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r[0] for r in tables[0]) == sorted(r.doc_id for r in scored.where("score >= 0.5").collect())
    near, _ = brute_near([(r[0], r[1]) for r in tables[0]])
    assert sorted(r[0] for r in tables[1]) == sorted({c for _, _, c in near})
    items = [tuple(map(decontaminate.shingles, decontaminate.split_item(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = lambda t: any(all(sum(x in near for x in s) >= k * len(s) for s, k in zip(item, (0.75, 0.5))) for near in [decontaminate.shingles(decontaminate.words_of(t))] for item in items)
    assert sorted(r[0] for r in tables[2]) == sorted(r[0] for r in tables[1] if not held(r[1]))
    n = [len(r[1].split()) for r in tables[2]]
    assert abs(sum(len(r[1].split()) for r in tables[3]) - sum(n)) <= 40 * max(n)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).orderBy("start").collect()
    want = Counter((r[0], zlib.crc32(np.array([*library.encode(r[1], add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in tables[3])
    assert Counter((r.doc_id, r.ids_crc32) for r in last) == want
    assert [r.start for r in last] == [0, *np.cumsum([r.n_tokens for r in last])[:-1].tolist()]
