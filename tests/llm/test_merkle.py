"""The Merkle log: positions, proofs, ties, nulls, lone leaves and empty tables, against plain loops."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from fieldwave.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, rank int, tree string"


def digest(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, more=0):
    n = r["n_chars"] + more if r["n_chars"] is not None else None
    return digest(*map(cell, (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def brute(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {t: levels_of([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in names}
    top = levels_of([built[t][-1][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded, proof = leaf_of(r, 1 if hit else 0), []
            for at, levels in ((i, built[t]), (k, top)):
                for level in levels[:-1]:
                    run = level[at - at % 2 : at - at % 2 + 2]
                    proof += run[: at % 2] + run[at % 2 + 1 :]
                    folded = digest(*run[: at % 2], folded, *run[at % 2 + 1 :])
                    at //= 2
            root = top[-1][0]
            out.append((r["doc_id"], leaf, built[t][-1][0], root, digest(*proof), folded, folded == root))
    return sorted(map(repr, out))


def answer(spark, rows, **options):
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1, "y") for r in rows], SCHEMA)
    return sorted(repr(tuple(r)) for r in merkle.verify(merkle.build_manifest(docs, claim=merkle.tampered_leaf(), **options)).collect())


def rows_for(counts):
    return [dict(doc_id=1000 * k + i, text=f"text é {i}", lang=t, source=None if i % 5 == 0 else f"s{i % 3}", n_chars=None if i % 11 == 0 else i) for k, (t, n) in enumerate(counts) for i in range(n)]


def test_positions_are_places_in_the_log():
    for n in range(1, 40):
        height = (n - 1).bit_length()
        leaves = [digest(str(i)).encode() for i in range(n)]
        for h in range(height, height + 2):
            log, levels = merkle.postorder(leaves, h), [leaves]
            for _ in range(h):
                levels.append([merkle.node_hash(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
            assert len(log) == merkle.subtree_size(n, h) == sum(map(len, levels))
            for k, level in enumerate(levels):
                assert [log[merkle.position(k, i, n)] for i in range(len(level))] == level


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_against_plain_loops(spark, bits):
    """Lone leaves, several rounds, one tree with most of the rows, a null and an empty tree name; every tampered row is found and no other."""
    rows = rows_for([("en", 75), (None, 1), ("", 2), ("é", 9), ("a", 1), ("z", 16)])
    got = answer(spark, rows, bits=bits)
    assert got == brute(rows)
    assert {eval(r)[-1] for r in got} == {True, False}


def test_one_row_and_one_tree(spark):
    for counts in ([("en", 1)], [("en", 5)], [(None, 3)]):
        rows = rows_for(counts)
        assert answer(spark, rows, bits=2) == brute(rows)


def test_ties_nulls_long_texts_and_large_numbers(spark):
    rows = [dict(doc_id=i, text=t, lang=lang, source="s", n_chars=n) for i, t, lang, n in [(7, "a", "en", 1), (7, "a", "en", 1), (7, "b", "en", 1), (None, None, None, None), (None, "", "en", 0), (3, "x" * 3_000_000, "en", 2**63 - 1), (2**62 + 1, "퟿\n\0", "de", -1)]]
    rows += [dict(doc_id=i, text="t", lang="en", source="s", n_chars=2**63 - 1) for i in range(8, 40)]  # some are tampered
    assert answer(spark, rows, bits=1) == brute(rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    manifest = merkle.build_manifest(docs)
    assert manifest.root is None and merkle.verify(manifest).collect() == []


def test_a_root_does_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    roots = {merkle.build_manifest(d, bits=b).root for d in (docs, docs.repartition(7)) for b in (1, 3, 8)}
    assert len(roots) == 1
    whole = merkle.build_manifest(docs, bits=3)
    assert len(whole.rounds) > 1
    proofs = merkle.verify(whole, with_proof=True)
    assert all(r.verified and merkle.node_hash(*(p.encode() for p in r.proof)).decode() == r.proof_sha256 for r in proofs.collect())
