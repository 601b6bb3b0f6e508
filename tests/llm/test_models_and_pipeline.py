"""Classifiers, chat windows and the pipeline on small tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from clausegraph.llm import chat, quality, toxicity
from clausegraph.llm.queries import OP7_SQL, ORACLES, QUERIES


def sentence(rng, n):
    syllables = ["the", "er", "on", "ti", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def junk(rng, n):
    text = sentence(rng, n)
    return rng.choice([text.upper(), text.replace(" ", " | "), " ".join([text.split()[0]] * n), text.replace(" ", "%%% "), "\n".join([text[:60]] * 9)])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(500):
        bad, toxic = rng.random() < 0.25, rng.random() < 0.2
        text = junk(rng, rng.randrange(20, 200)) if bad else "\n".join(sentence(rng, rng.randrange(8, 40)) for _ in range(rng.randrange(1, 8)))
        if toxic:
            words = text.split(" ")
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "worthless"]))
            text = " ".join(words)
        docs.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(600, None), (601, ""), (None, docs[0][1]), (3, docs[3][1]), (602, "x" * 1_000_000)]
    labels += [(None, 1, 1), (5, None, None), (700, 1, 0), (8, 1, 1), (8, 0, 0), (9, labels[9][1], labels[9][2])]
    return docs, labels


def frames(spark, corpus):
    docs, labels = corpus
    table = spark.createDataFrame([(d, t, 5, 0.5) for d, t in docs], "doc_id bigint, text string, label int, score double")
    return table, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(
    ("score", "column", "fold", "held"), [(quality.score_quality, 1, 5, 0), (toxicity.score_toxicity, 2, 4, 2)]
)
def test_classifiers_on_their_held_out_fold(spark, corpus, score, column, fold, held):
    docs, labels = corpus
    table, marks = frames(spark, corpus)
    got = score(table, marks).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in docs)
    truth = {x[0]: x[column] for x in labels[:500]}
    right = 0
    tested = [r for r in got if r.doc_id in truth and r.held_out]
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % fold == held)
    right = sum(r.predicted == truth[r.doc_id] for r in tested)
    assert len(tested) > 50 and right >= 0.95 * len(tested)


@pytest.mark.parametrize(("score", "column"), [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_held_out_labels_are_never_seen(spark, corpus, score, column):
    table, marks = frames(spark, corpus)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % (5 if column == "quality" else 4)
    wrong = marks.withColumn(column, F.when(fold == (0 if column == "quality" else 2), 1 - F.col(column)).otherwise(F.col(column)))
    pick = lambda df: {(str(r.doc_id), round(r.score, 9)) for r in df.collect()}
    assert pick(score(table, marks)) == pick(score(table, wrong))


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifiers_without_labels_or_rows(spark, corpus, score):
    table, marks = frames(spark, corpus)
    assert score(table.limit(0), marks).count() == 0
    alone = score(table.filter("doc_id < 20"), marks.limit(0)).collect()
    assert len({r.score for r in alone}) == 1 and len(alone) == 21
    one_class = score(table, marks.filter("quality = 1 and toxic = 0")).collect()
    assert len({r.score for r in one_class}) == 1


def test_rejected_documents_go(spark, corpus):
    docs, _ = corpus
    table, marks = frames(spark, corpus)
    kept = quality.keep_good(table, marks)
    assert kept.schema == table.schema
    scored = quality.score_quality(table, marks).filter("predicted = 1").groupBy("doc_id").count().collect()
    assert sorted((str(r.doc_id), r["count"]) for r in kept.groupBy("doc_id").count().collect()) == sorted((str(r.doc_id), r["count"]) for r in scored)


def conversations():
    rng = random.Random(4)
    odd = ["<|im_end|>", "<|im_start|>assistant ok", "\\", "<\\|", "<|", "\n", "é🙂", "", None, "a < b | c", "\\n", "<<||>>", "<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"]
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 14)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "assistant", "tool", None, "odd\nrole", "<|im_end|>"])
            rows.append((c, t, role, rng.choice(odd) if rng.random() < 0.3 else sentence(rng, rng.choice([3, 50, 400]))))
    rows += [(40, t, "assistant" if t % 2 else "user", "word " * 90) for t in range(150)]
    rows += [(41, 0, "assistant", "twice"), (41, 0, "assistant", "twice"), (41, 0, "user", "tie"), (42, None, "user", "no turn"), (42, 3, "assistant", "x"), (None, 0, "user", "no id"), (None, 1, "assistant", "y")]
    return rows + [(43, 0, "assistant", "long " * 50_000)]


def test_windows_read_back_and_sql_agree(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, window string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op7_chat_windows"](spark, str(tmp_path)).collect()
    want: dict = {}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    said = "<|im_end|><|im_start|>assistant ok"
    for c, _, role, text in sorted([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)], key=order):
        n, turns, loss = want.get(c, (0, "", ""))
        want[c] = (n + 1, turns + f"{role or ''}\n{text or ''}\n", loss + ((text or "") if role == "assistant" else ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {
        (c, n, sha(turns), len(loss), sha(loss)) for c, (n, turns, loss) in want.items()
    }
    assert len(got) == len(want)
    db = duckdb.connect()
    db.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    sql = {(r[0], r[-1]) for r in db.execute(OP7_SQL).fetchall()}
    assert {(r.conv_id, r.formatted_chars) for r in got} == sql


def test_windows_keep_the_budget(spark):
    rows = [(1, 0, "system", "rules " * 20)] + [(1, t, "assistant" if t % 2 else "user", "word " * 60) for t in range(1, 60)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = chat.format_windows(turns, budget=512, history=128).orderBy("window").collect()
    assert len(windows) > 5
    for k, w in enumerate(windows):
        assert w.formatted.startswith("<|im_start|>system\n")
        assert (w.n_context > 1) == (k > 0)
        for s in w.loss:
            assert w.formatted[s.first : s.last] == "word " * 60
    assert sum(len(w.loss) for w in windows) == 30
    with pytest.raises(ValueError):
        chat.format_windows(turns, budget=100, history=80)
    assert chat.read_windows(chat.format_windows(turns.limit(0))).count() == 0


def test_windows_stay_within_the_budget(spark):
    rng = random.Random(4)
    rows = [(1, 0, "system", "rules " * 20)] + [(1, t, "assistant" if t % 2 else "user", "word " * 60) for t in range(1, 60)]
    rows += [(2, t, "assistant" if t % 2 else "user", "word " * rng.choice([0, 1, 9, 70, 200, 300, 600])) for t in range(120)]
    rows += [(3, 0, "system", "rule " * 600), (3, 1, "user", "word " * 3), (3, 2, "assistant", "word " * 4)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = chat.format_windows(turns, budget=512, history=128)
    words = {c: [(r, len(t.split()) + chat.OVERHEAD) for k, _, r, t in rows if k == c] for c in (1, 2, 3)}
    got = sorted(windows.collect(), key=lambda w: (w.conv_id, w.window))
    done = {1: 0, 2: 0, 3: 0}
    for w in got:
        turn = [x.split("\n", 1) for x in w.formatted.split("<|im_start|>")[1:]]
        sizes = [len(body.replace("<|im_end|>", "").split()) + chat.OVERHEAD for _, body in turn]
        mine, new = words[w.conv_id], sizes[w.n_context :]
        system = mine[0][1] if mine[0][0] == "system" else 0
        assert new == [n for _, n in mine[done[w.conv_id] :][: len(new)]] and new
        assert sum(sizes) <= 512 or len(new) == 1 and new[0] > 512 - 128 - system or system > 384
        # all earlier turns that fit into the history stand before the new ones
        held, n = [], 0
        for _, size in reversed(mine[1 if system else 0 : done[w.conv_id]]):
            n += size
            if n > 128:
                break
            held.insert(0, size)
        assert sizes[: w.n_context] == ([system] if system and done[w.conv_id] else []) + held
        done[w.conv_id] += len(new)
    assert done == {c: len(x) for c, x in words.items()}
    text = lambda role, c: "".join(f"{r}\n{t}\n" if role is None else t * (r == role) for k, _, r, t in rows if k == c)
    plain = {c: (len(words[c]), text(None, c), text("assistant", c)) for c in words}
    assert {r.conv_id: (r.n_turns, r.turns, r.learned) for r in chat.read_windows(windows).collect()} == plain


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns, name
        kept = out.cache()
        sizes.append(kept.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    final = corpus_pipeline.run(spark, sf_dir).collect()
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    for (name, _), n in zip(corpus_pipeline.STAGES, sizes[1:]):
        [path] = folder.glob(name.replace(" ", "-") + "-*")
        assert spark.read.parquet(str(path)).count() == n
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in final} == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in texts.items()}
