from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segmenta.llm import binary, counts, tokens

ODD = ["", " ", "a  b", " lead", "trail ", "a\n\nb", "a\nb c\td", "it's 's x'll", "日本 語 テ　 x", "é è  x", None, "x" * 5000 + " y z", "a  b", "…  —  ok\r\n z", "\x1c a \x1c b", "<|endoftext|> a", "word " * 4000, "a b", "a b"]


@pytest.fixture(scope="module")
def coder():
    return tokens.Encoder(tokens.vocabulary_path())


def test_units_encode_like_whole_texts(coder):
    for _ in range(2):  # the second time from the memo
        ids, n = coder.column(pa.array(ODD))
        at = 0
        for text, k in zip(ODD, n, strict=True):
            assert ids[at : at + k].tolist() == coder.coder.encode_ordinary(text or "")
            at += k
        assert at == len(ids)
    assert len(coder.column(pa.array([], pa.string()))[0]) == 0


def test_memo_that_is_full_changes_nothing(coder, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_UNITS", 2)
    own = tokens.Encoder(tokens.vocabulary_path())
    for _ in range(3):
        assert own.column(pa.array(ODD))[0].tolist() == coder.column(pa.array(ODD))[0].tolist()


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("ids", [[], [0], [7] * 9, list(range(1000)), [50256, 0, 65535], [1 << 20, 3]])
def test_planes_round_trip(bits, ids):
    ids = np.array(ids, np.uint32)
    sizes, data = binary.pack(ids, bits)
    assert binary.unpack(len(ids), sizes, data, bits).tolist() == ids.tolist() and sum(sizes) == len(data)


@pytest.mark.parametrize("block", [1, 100, 1 << 16])
def test_written_ids_round_trip(spark, coder, block):
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(ODD[:-3] if block == 1 else ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, data string").repartition(3)
    chunks = binary.write_ids(docs, block=block).cache()
    assert chunks.where(F.col("n_ids") > block).count() == 0
    back = binary.read_ids(chunks).collect()
    key = lambda d, ids: (d is None, d or 0, ids)
    assert sorted(key(r.doc_id, r.ids) for r in back) == sorted(key(d, coder.coder.encode_ordinary(t or "")) for d, t, _ in rows)
    for r in chunks.collect():
        assert sum(r.plane_bytes) == len(r.data) and sum(r.doc_ids) == r.n_ids
    by = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.stream, r.chunk)):
        assert r.position == by.get(r.stream, 0)
        by[r.stream] = r.position + len(r.data)


def test_files_are_read_by_position(spark, coder, tmp_path):
    rows = [(1, "one two three"), (2, None), (3, ""), (3, ""), (None, "no id"), (4, "long " * 3000), (5, "last"), (5, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("clash")).repartition(3)
    folder = str(tmp_path / "ids")
    index = binary.write_files(docs, folder, block=512)
    assert "data" not in index.columns and index.count() > 6 and index.agg(F.max("position")).first()[0] > 0
    assert not [p for p in (tmp_path / "ids").iterdir() if p.name.endswith(".part")]
    key = lambda df: sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in df.collect())
    want = sorted((i is None, i or 0, coder.column(pa.array([t], pa.string()))[0].tolist()) for i, t in rows)
    assert key(binary.read_files(spark, folder)) == want
    some = spark.createDataFrame([(4,), (None,), (3,), (77,)], "doc_id long")
    assert key(binary.read_files(spark, folder, some)) == [w for w in want if w[0] or w[1] in (3, 4)]
    empty = str(tmp_path / "none")
    assert binary.write_files(docs.where("false"), empty).count() == binary.read_files(spark, empty).count() == 0


def test_no_documents_no_chunks(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert binary.write_ids(empty).count() == 0 and counts.count_tokens(empty).count() == 0


def splice(data: bytes, edits):
    for a, n, new in sorted(edits, reverse=True):
        data = data[:a] + new + data[a + n :]
    return data


def test_edited_counts_are_those_of_encoding_anew(coder, monkeypatch):
    monkeypatch.setattr(counts, "LEAF_BYTES", 12)
    rng = random.Random(5)
    words = ["a", "the", " ", "  ", "\n", "\n\n", "it's", "naïve", "x1", "…", "ñandú", "12", "\t"]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(60)))
        data = text.encode()
        sizes, n, _ = counts.leaves(np.frombuffer(data, np.uint8), np.array([0, len(data)]), coder)
        tree = counts.Tree(sizes.tolist(), n.tolist())
        assert tree.tokens[1] == len(coder.coder.encode_ordinary(text))
        edits, at = [], 0
        while at <= len(text) and rng.random() < 0.8:
            at += rng.randrange(12)
            k = rng.randrange(4)
            if at + k > len(text):
                break
            b = len(text[:at].encode())
            edits.append((b, len(text[at : at + k].encode()), rng.choice(["", " ", "x", " new word ", "\n", "é"]).encode()))
            at += k + 1
        new, made, _ = counts.apply_edits(data, tree, edits, coder.coder)
        assert new == splice(data, edits) and made == len(edits)
        assert tree.tokens[1] == len(coder.coder.encode_ordinary(new.decode())), (text, edits)
        assert tree.size[1] == len(new)


def test_only_touched_leaves_are_encoded(coder):
    data = ("some words stand here " * 5000).encode()
    sizes, n, _ = counts.leaves(np.frombuffer(data, np.uint8), np.array([0, len(data)]), coder)
    tree = counts.Tree(sizes.tolist(), n.tolist())
    new, _, work = counts.apply_edits(data, tree, [(50_000, 3, b"XYZ")], coder.coder)
    assert work < 4 * counts.LEAF_BYTES and tree.tokens[1] == len(coder.coder.encode_ordinary(new.decode()))


def test_overlapping_and_outlying_edits(coder):
    tree = counts.Tree([5], [len(coder.coder.encode_ordinary("héllo"[:4]))])
    new, made, _ = counts.apply_edits("héll".encode(), tree, [(2, 1, b"e"), (0, 2, b"J"), (99, 5, b"!")], coder.coder)
    assert made == 3 and new.decode(errors="replace").endswith("!")


def test_counts_over_a_table_and_kept_trees(spark, coder):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(99, "write to jo@a.example.com or +1 (222) 555-1234 or 10.0.0.1 now " * 40, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens long")
    got = {r.doc_id: r for r in counts.count_tokens(docs).collect()}
    for i, t, _ in rows:
        assert got[i].tokens_before == len(coder.coder.encode_ordinary(t or ""))
        new = splice((t or "").encode(), counts.redactions((t or "").encode())).decode()
        assert got[i].tokens == len(coder.coder.encode_ordinary(new)) == got[i].tree[1]
    assert got[99].edits == 120
    kept = counts.count_tokens(docs, redact=False).select("doc_id", "leaf_bytes", "tree").join(docs.drop("tokens"), "doc_id")
    edit = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit("New. ").alias("text"))))
    for r in counts.recount(kept.withColumn("edits", edit)).collect():
        text = dict((i, t) for i, t, _ in rows)[r.doc_id] or ""
        assert (r.text or "") == ("New. " + text if r.doc_id % 2 == 0 else text)
        assert r.tokens == len(coder.coder.encode_ordinary(r.text or ""))
