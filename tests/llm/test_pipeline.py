"""Chats, mixing and the pipeline."""

from __future__ import annotations

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from segmenta.llm import binary, chat, decontamination, langid, mixing, simhash, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_mix(rows, weights=None, total=None):
    """(source, epoch, doc_id, tokens, start, take), one document after another."""
    by = {}
    for d, t, _, s, _ in rows:
        by.setdefault(s, []).append((hashlib.md5(f"{'null' if d is None else d}:{mixing.SEED}".encode()).hexdigest(), d is not None, d or 0, len((t or "").split()), d))
    weights = {s: (weights or {}).get(s, 1) for s in by}
    total = sum(x[3] for v in by.values() for x in v) if total is None else total
    out = []
    for s, own in by.items():
        budget, at, epoch = total * weights[s] // sum(weights.values()), 0, 0
        own = [x for x in sorted(own, key=lambda x: x[:4]) if x[3]]
        while own and at < budget:
            for x in own:
                if at >= budget:
                    break
                take = min(x[3], budget - at)
                out.append((s, epoch, x[4], x[3], at, take))
                at += x[3]
            epoch += 1
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize(("weights", "total", "bucket"), [(None, None, 20_000), ({"a": 3, "b": 0}, 500, 20_000), (None, 97, 5), ({"c": 1000}, None, 7)])
def test_mix_equals_brute_force(spark, monkeypatch, weights, total, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(12))), "en", rng.choice(["a", "a", "a", "b", None]), 0) for i in range(80)]
    rows += [(None, "x y z", "en", "c", 0), (7, "again and again", "en", "a", 0), (7, "again and again", "en", "a", 0), (200, None, "en", "a", 0), (201, None, "en", "empty", 0), (202, "long " * 5000, "en", "b", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("tokens", F.lit("clash")).withColumn("_key", F.lit(1))
    got = [tuple(r) for r in mixing.mix(docs, weights, total).collect()]
    assert sorted(map(key, got)) == sorted(map(key, brute_mix(rows, weights, total)))
    texts = mixing.mix_documents(docs, weights, total).collect()
    assert sum(len(r.text.split()) for r in texts) == sum(r[5] for r in got) and len(texts) == len(got)
    assert all(r.n_chars == len(r.text) for r in texts if len(r.text.split()) < 5000 and r.n_chars)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).count() == mixing.mix_documents(empty).count() == 0


CHATS = [
    (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", ""), (2, 0, "user", "u"), (2, 1, "user", "v"), (3, 0, "user", None), (4, 0, "assistant", "a"), (5, 0, "system", "s"),
    (6, 0, "user", "u"), (6, 0, "assistant", "a"), (None, 0, "user", "q"), (None, 1, "assistant", "r" * 100_000), (7, None, "user", "u"), (8, 0, "robot", "x"), (9, 0, "user", "u"), (9, 1, "assistant", "a"), (9, 2, "tool", "t"), (9, 3, "assistant", "b"),
]


def test_chats_by_machine_and_by_sql(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(CHATS, schema).withColumn("error", F.lit("clash")).withColumn("position", F.lit(9))
    got = [tuple(r) for r in chat.format_chats(df).collect()]
    errors = {r[0]: r[-1] for r in got if r[-1] is not None}
    assert errors == {2: "bad_transition", 3: "null_field", 4: "bad_transition", 5: "bad_end", 6: "repeated_turn", 7: "null_field", 8: "bad_transition"}
    one = sorted((r.position, r.segment, r.segment_text, r.loss) for r in chat.format_chats(df).where("conv_id = 1").collect())
    assert "".join(x[2] for x in one) == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\n<|end|>\n"
    assert [x[3] for x in one] == [False] * 6 + [False, True, True]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", CHATS)
    columns = chat.format_chats(df).columns
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({chat.chats_sql()})").fetchall()
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert chat.format_chats(df.where("false")).count() == 0


def test_chats_of_any_machine(spark, monkeypatch):
    """States that aren't named by roles: a critic speaks once at most, after two turns of the assistant."""
    monkeypatch.setattr(chat, "BLOCK", 3)
    machine = {"start": {"user": "asked"}, "asked": {"assistant": "one"}, "one": {"user": "asked", "assistant": "two"}, "two": {"critic": "judged", "user": "asked"}, "judged": {}}
    template = chat.TEMPLATE | {"critic": [("<c>", False), ("{text}", False)]}
    rng, rows, want = random.Random(6), [], {}
    for conv in range(120):
        seq = [rng.choice(["user", "assistant", "assistant", "critic"]) for _ in range(rng.randrange(1, 12))]
        if conv % 2:
            seq = ["user", "assistant", "assistant"] * rng.randrange(1, 5) + ["critic"] * (conv % 4 == 1)
        state = "start"
        for r in seq:
            state = machine.get(state, {}).get(r) if state else None
        want[conv] = "bad_transition" if state is None else None if state in ("two", "judged") else "bad_end"
        rows += [(conv, 7 * i, r, f"t{i}") for i, r in enumerate(seq)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("error", F.lit("clash")).withColumn("position", F.lit(-1))
    got = {}
    for r in chat.format_chats(turns, machine, ("two", "judged"), template).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert {k: v[0].error for k, v in got.items()} == want and len(set(want.values())) == 3
    for conv, v in got.items():
        if v[0].error is None:
            texts = [r.segment_text for r in sorted(v, key=lambda r: (r.position, r.segment)) if r.segment_text.startswith("t")]
            assert texts == [t for _, _, _, t in sorted(x for x in rows if x[0] == conv)] and sorted({r.position for r in v}) == list(range(len(texts)))
    with pytest.raises(ValueError, match="critic"):
        chat.format_chats(turns, machine, ("two",))
    assert chat.format_chats(turns.where("false"), machine, ("two",), template).count() == 0


def test_stages_equal_their_operators(spark, tmp_path):
    """Each stage on all that its predecessor kept, against the operators run by hand, and the ids read back."""
    rng = random.Random(9)
    syllables = {"en": ["the", "ing", "and", "wh"], "de": ["sch", "ung", "ein", "ich"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(20, 90)), lang, f"s{i % 3}", 0) for i in range(60) for lang in [rng.choice(["en", "de"])]]
    item = text("en", 12)
    rows += [(100, rows[0][1], "en", "s0", 0), (101, rows[1][1] + " more", "en", "s1", 0), (102, f"{text('en', 20)} {item}", "en", "s2", 0), (103, None, "en", "s0", 0), (104, "", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "mixing", "token_ids"]
    at, seen = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        at = spark.read.parquet(str(tmp_path / f"stage{i}"))
        assert at.columns == docs.columns
        seen.append({r.doc_id for r in at.collect()})
    judged = {r.doc_id for r in langid.identify(docs).where("kept").collect()}
    assert seen[0] == judged and not {103, 104} & judged
    drop = {r.doc_id for r in simhash.near_groups(docs.where(F.col("doc_id").isin(*judged))).where("NOT kept").collect()}
    assert seen[1] == judged - drop and {100, 101} <= drop
    assert seen[2] == seen[1] - {r.doc_id for r in decontamination.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} and 102 not in seen[2]
    kept = [r for r in rows if r[0] in seen[2]]
    mixed = brute_mix(kept)
    assert seen[3] == {r[2] for r in mixed}
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = binary.read_ids(out).collect()
    coder = tokens.encoding(tokens.vocabulary_path())
    assert len(ids) == len(mixed)
    texts = {r[0]: r[1] for r in kept}
    for r in ids:
        full = coder.encode_ordinary(texts[r.doc_id])
        assert r.ids == full or coder.decode(r.ids) == texts[r.doc_id][: len(coder.decode(r.ids))]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns, then no rows at all."""
    rng = random.Random(10)
    text = lambda n: " ".join("".join(rng.choice(["the", "ing", "and", "wh", "er"]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(40), "en", "s", 1) for i in range(20)] + [(50, None, None, None, None), (51, "", "", "", 0), (None, text(30), None, "s", None), (52, text(30_000), "en", None, 7), (3, None, "en", "s", 1)]
    rows += [rows[4], rows[4]]
    clash = {c: F.lit("clash") for c in ("node", "n", "first", "rows", "r0", "tokens", "epoch", "_key", "_bucket", "part", "key", "stream", "doc", "item_id", "detected", "kept")}
    odd = spark.createDataFrame(rows, DOCS).withColumns(clash)
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs, some in ((odd, True), (odd.where("false"), False)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{some}{i}"))
            out = spark.read.parquet(str(tmp_path / f"{some}{i}"))
            assert (out.count() > 0) == some and (i == 4 or sorted(out.columns) == sorted(DOCS.replace(" long", "").replace(" string", "").split(", ")))
            if some and name == "simhash_near_dedup":
                assert sorted(r.doc_id for r in out.where("doc_id = 4").collect()) == [4] and out.where("doc_id = 52").count() == 1
            docs = out.withColumns({k: x for k, x in clash.items() if k not in out.columns}) if i < 4 else out
        spark.createDataFrame([], DOCS).count()


def test_shared_folder_is_the_sessions(spark):
    from segmenta.llm import common

    assert common.shared_folder(spark).removeprefix("file:").startswith(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
