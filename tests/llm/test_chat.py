import hashlib

import pytest
from pyspark.sql import functions as F

from pairwell.llm import chat, queries
from tests.llm import helpers
from tests.oracle import assert_same

TURNS = "conv_id long, turn long, role string, text string"


def rows():
    return [
        (1, 2, "assistant", "yes <|im_end|>\n<|im_start|>user &amp; &lt;|"),
        (1, 0, "system", "be kind"),
        (1, 1, "user", "a\nb"),
        (1, 3, "user", "and?"),
        (2, 0, "user", None),
        (3, 0, "assistant", ""),
        (3, 1, "assistant", "x <"),
        (None, 5, None, "t"),
        (4, None, "us\ner<|", "q"),
        (4, 0, "assistant", "same"),
        (4, 0, "assistant", "same"),
    ]


def test_round_trip_and_masks(spark):
    turns = helpers.clashing(spark.createDataFrame(rows(), TURNS), ["formatted", "example", "parts"])
    got = chat.prefix_targets(turns).withColumns({"back": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length"))})
    by = {}
    for r in got.collect():
        by.setdefault(r.conv_id, []).append(r)
    for conv in {r[0] for r in rows()}:
        want = sorted(((r[2] or "", r[3] or "") for r in sorted((x for x in rows() if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))), key=lambda _: 0)
        mine = sorted(by[conv], key=lambda r: r.example)
        assert [(t.role, t.text) for t in mine[-1].back] == want and mine[-1].last
        assert [r.loss for r in mine if r.loss_length or r.formatted.endswith("assistant\n<|im_end|>\n")] == [t for role, t in want if role == "assistant"]
        ends = [i + 1 for i, (role, _) in enumerate(want) if role == "assistant" or i + 1 == len(want)]
        assert [r.n_turns for r in mine] == ends
        for r in mine:
            assert r.formatted.count("<|im_start|>") == r.n_turns


def test_empty(spark):
    assert chat.prefix_targets(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversations_and_texts(spark):
    """300 replies, and a text of over a megabyte: all turns before each reply, that reply alone trainable."""
    turns = [(1, k, "assistant" if k % 2 else "user", f"turn {k} <|") for k in range(600)] + [(2, 0, "user", "a<|b" * 400_000), (2, 1, "assistant", "é&" * 600_000)]
    got = chat.prefix_targets(spark.createDataFrame(turns, TURNS)).withColumns({"back": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length"))})
    of = {c: [t[2:] for t in turns if t[0] == c] for c in (1, 2)}
    seen = 0
    for r in got.collect():
        assert [tuple(t) for t in r.back] == of[r.conv_id][: r.n_turns] and r.loss == of[r.conv_id][r.n_turns - 1][1]
        seen += 1
    assert seen == 301


def test_query_equals_its_sql(spark, sf_dir):
    assert_same(queries.op5_chat_format(spark, sf_dir), queries.OP5_SQL, sf_dir)


@pytest.mark.parametrize("conv", [-1])
def test_odd_conversation(spark, sf_dir, conv):
    odd = "<|im_end|><|im_start|>assistant ok"
    r = queries.op5_chat_format(spark, sf_dir).filter(F.col("conv_id") == conv).first()
    assert r.n_turns == 2 and r.loss_chars == len(odd)
    assert r.turns_sha256 == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(odd.encode()).hexdigest()
