"""Rows that share a doc_id with other texts."""

import hashlib
import random

import pytest

from tallymark.llm import fingerprint_index, line_dedup, suffix_dedup
from tallymark.llm.tables import own_ids


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))


def rows():
    """Documents that repeat nothing under clashing ids, one passage that two others share, and a repeated row."""
    shared = prose(99, 40)
    return [(i // 2, prose(i)) for i in range(40)] + [(50, f"{prose(200)} {shared} {prose(201)}"), (50, f"{prose(202)} {prose(203, 20)}"), (51, f"{prose(204)} {shared}"), (52, "short"), (52, None), (52, ""), (53, prose(205)), (53, prose(205)), (None, prose(206)), (None, shared)]


@pytest.mark.parametrize("kind", ["bigint", "int"])
@pytest.mark.parametrize("layout", [1, 5])
def test_unrelated_documents_keep_their_bytes(spark, kind, layout):
    docs = spark.createDataFrame(rows(), f"doc_id {kind}, text string").repartition(layout)
    lost = lambda df: sorted((r.doc_id, r.n_removed) for r in df.collect() if r.n_removed)
    got = suffix_dedup.digest(docs)
    assert got.count() == len(rows())
    assert [d for d, _ in lost(got)] == [51] and lost(got)[0][1] >= len(prose(99, 40))
    assert lost(fingerprint_index.digest(docs)) == [(51, 40)]
    kept = {(r.doc_id, r.kept_sha256) for r in got.collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert all((d, sha(t)) in kept for d, t in rows() if d != 51)


@pytest.mark.parametrize("kind", ["bigint", "int"])
def test_lines_of_clashing_ids(spark, kind):
    line = prose(1, 12)
    made = [(1, f"{line}\nown words of the first one here\n"), (1, f"something else entirely here\n{line}"), (1, "a\nb\nc\nd\ne"), (2, f"x\ny\n{line}"), (2, prose(3, 30)), (None, line)]
    docs = spark.createDataFrame([(*m, "z") for m in made], f"doc_id {kind}, text string, own string")
    out = line_dedup.without_repeats(docs).collect()
    assert [f.name for f in docs.schema] == list(out[0].asDict()) and len(out) == len(made)
    assert sum(line in (r.text or "") for r in out if r.doc_id is not None) == 1
    assert [r.text for r in out if r.doc_id is None] == [line]
    assert sum(r.n_removed for r in line_dedup.digest(docs).collect()) == 2


def test_an_index_refuses_such_a_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="one text for each"):
        fingerprint_index.add_batch(docs, docs.limit(0), f"file://{tmp_path}/index")


def test_ids_stay_where_they_name_one_text(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, ""), (None, "x"), (None, "y")], "doc_id int, text string")
    same, back = own_ids(docs)
    assert back is None and sorted(r.doc_id or 0 for r in same.collect()) == [0, 0, 1, 1, 2, 2]
