"""Chat formatting, mixing and quality rules on awkward rows, against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest
from fixtures import no_documents, odd_documents, sentence

from sourcemark.llm import chat, mixing, quality_rules


def conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", chat.PROBE_TEXT),
        (2, 1, "assistant", "b"), (2, 0, "user", "a\\"), (2, 2, "user", "### User: </turn>"), (2, 2, "user", "### User: </turn>"),
        (3, 0, None, None), (3, None, "tool </role>", "\\\\</turn"), (3, 5, "assistant", ""),
        (None, 0, "user", "x"), (None, 1, "assistant", "long " * 50_000),
        (4, 0, "system", "s"), (4, 1, "user", "####  ### User: "), (4, 2, "assistant", "ok"), (4, 3, "user", "\n"), (4, 4, "assistant", "ü" * 9),
    ]
    rows += [(5, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(2000)]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "conv_id bigint, turn bigint, role string, text string, seq int")


def test_conversations_come_back_whole(spark, tmp_path):
    groups = defaultdict(list)
    for r in conversations(spark).collect():
        groups[r.conv_id].append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.round_trip(conversations(spark), f"file://{tmp_path}/chat").collect()}
    assert set(got) == set(groups)
    for conv_id, turns in groups.items():
        turns = [(role, text) for _, role, text in sorted(turns)]
        learned = "".join(text for role, text in turns if role == "assistant")
        row = got[conv_id]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        roles = [r for r, _ in turns]
        allowed = {("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
        assert row.valid == (all(p in allowed for p in zip(["start", *roles], roles, strict=False)) and roles[-1] == "assistant")
    assert chat.round_trip(conversations(spark).limit(0), f"file://{tmp_path}/none").count() == 0


def test_own_template(spark, tmp_path):
    template = chat.Template({"human": chat.Role("<h>", after=("start",)), "bot": chat.Role("<b>", True, ("human",))}, other="<o>", final=("bot",))
    rows = spark.createDataFrame([(1, 0, "human", "<b>"), (1, 1, "bot", "<h>\\")], "conv_id bigint, turn bigint, role string, text string")
    segments = chat.format_conversations(rows, template).orderBy("seq", "part").collect()
    assert "".join(s.text for s in segments) == "<h>\\<b></turn><b>\\<h>\\\\</turn>"
    assert [s.loss for s in segments] == [False] * 4 + [True, False]
    assert chat.round_trip(rows, f"file://{tmp_path}/own", template).first().valid


def test_mix_on_odd_documents(spark):
    docs = odd_documents(spark)
    rows = mixing.mixture(docs).collect()
    sizes = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect())
    assert sorted(r["size"] for r in rows) == sizes
    sources = {(r.source_size, r.target) for r in rows}
    assert all(target <= 3 * size for size, target in sources)
    assert sum(t for _, t in sources) == pytest.approx(sum(sizes))
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixture(docs.repartition(7)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.mixture(no_documents(spark)).count() == mixing.mix(no_documents(spark)).count() == 0


def test_shares_near_targets(spark):
    rows = [(i, sentence(i, 20 + i % 30), f"s{i % 4}") for i in range(4000)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    for r in got.groupBy("source_size", "target").sum("taken").collect():
        assert r["sum(taken)"] == pytest.approx(r.target, rel=0.15)


def repeated(words: list) -> int:
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    return len({i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)})


def test_rules_on_odd_documents(spark):
    docs = odd_documents(spark).unionByName(
        spark.createDataFrame([(100 + i, " ".join((sentence(i, 30) + " " + sentence(7, 8)).split() * (1 + i % 2))) for i in range(6)], "doc_id bigint, text string"),
        allowMissingColumns=True,
    )
    want = defaultdict(list)
    for r in docs.collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = repeated(words)
        want[r.doc_id].append((len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), n, len(words) < 10 or 100 * n > 20 * len(words)))
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in want[r.doc_id]
        assert r.kept == (not r.base_failed and r.broken == "")
    assert quality_rules.quality_rules(no_documents(spark)).count() == 0


def test_rules_are_one_projection_without_user_functions(spark):
    plan = quality_rules.quality_rules(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1  # the fixture's own repartition


def test_thresholds_are_a_table(spark):
    docs = spark.createDataFrame([(1, sentence(3, 50)), (2, "the " + sentence(3, 50).upper())], "doc_id bigint, text string")
    rule = (quality_rules.Rule("loud", "capital_share", high=0.5),)
    assert {r.doc_id: r.broken for r in quality_rules.quality_rules(docs, rule).collect()} == {1: "", 2: "loud"}
