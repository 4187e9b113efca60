"""Chat formatting: spans, masks, reversibility, history-rewriting templates, and the SQL of its query."""

import random
from itertools import groupby

import pytest

from textlab.llm import catalog, chat

PIECES = ["\\", "<", "|", ">", "[INST]", "[/INST]", "</s>", "<s>", "<|im_end|>", "<|im_start|>", "\n", "n", "a", "<<SYS>>", "é", "[", "probe"]
SCHEMA = "conv_id long, turn long, role string, text string, rendered string, kept string"


def test_escape_is_reversible_and_leaves_no_control_string():
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choices(PIECES, k=rnd.randint(0, 9)))
        out = chat.escape(text)
        assert not any(c in out for c in chat.CONTROL)
        assert chat.unescape(out) == text


def test_spans_of_the_default_template():
    turns = [("user", "probe"), ("a\nb</s>", ""), ("assistant", "</s>[INST] ok [/INST]"), ("", "\\n")]
    whole, found, kept = chat.spans(turns, chat.default_template)
    assert kept and whole == chat.default_template(turns)
    for (role, text), (a, b, c, d) in zip(turns, found):
        assert chat.read_back(whole[a:b], c - a, d - a) == (role, text)


def trimming(turns, first):
    return "".join(f"{r}:{t.strip()};" for r, t in turns)


def test_templates_that_rewrite_history_are_detected(make):
    def rewriting(turns, first):
        """Takes the texts of all turns but the last out of its output."""
        return "".join(f"{r}:{'' if k < len(turns) - 1 else t};" for k, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "hello", "", ""), (1, 1, "assistant", "yes", "", ""), (2, 0, "assistant", "alone", "", "")]
    out = chat.format_chats(make(SCHEMA, rows), rewriting).collect()
    assert {(r["conv_id"], r["kept"]) for r in out} == {(1, False), (2, True)}
    assert [r["loss"] for r in out if r["conv_id"] == 1] == [False, False]
    _, found, kept = chat.spans([("u", " x "), ("assistant", "yes")], trimming)
    assert kept and found[0][2:] == (2, 3)


@pytest.mark.parametrize("block", [1, 32])
@pytest.mark.parametrize("by_turn", [False, True])
def test_rewriting_is_detected_over_blocks(make, block, by_turn):
    def plain(turns, first):
        return "".join(f"{r}:{t.strip()};" for r, t in turns)

    def rewriting(turns, first):
        return "".join(f"{r}:{'' if k < len(turns) - 1 else t};" for k, (r, t) in enumerate(turns))

    def late(turns, first):
        """Takes back turn 31 alone, once a turn follows it."""
        return "".join(f"{r}:{'' if first + k == 31 and k < len(turns) - 1 else t};" for k, (r, t) in enumerate(turns))

    for template in (plain, rewriting, late):
        template.by_turn = by_turn
    n = {1: 33, 2: 1, 3: 600, 4: 32}
    rows = [(c, t, ["user", "assistant"][t % 2], f"text {t}", "", "") for c in n for t in range(n[c])]
    for template, kept in ((rewriting, {2}), (late, {2, 4}), (plain, {1, 2, 3, 4})):
        out = chat.format_chats(make(SCHEMA, rows), template, block=block).collect()
        assert {(r["conv_id"], r["kept"]) for r in out} == {(c, c in kept) for c in n}
        assert all(r["loss"] == (r["kept"] and r["role"] == "assistant") for r in out)
        assert all(r["content_start"] == r["content_end"] == 0 for r in out if not r["kept"])
        assert sorted((r["conv_id"], r["turn_no"]) for r in out) == [(c, t) for c in n for t in range(n[c])]
        assert all(r["rendered"][r["content_start"]:r["content_end"]] == f"text {r['turn_no']}" for r in out if r["kept"])


def test_black_boxes_see_the_whole_history(make):
    """What a template does long after a turn, or once before all turns, counts at every length."""
    def much_later(turns, first):
        """Takes back turn 0 once there are more than 100."""
        return "".join(f"{r}:{'' if len(turns) > 100 and k == 0 else t};" for k, (r, t) in enumerate(turns))

    def headed(turns, first):
        return "<s>" + "".join(f"{r}:{t};" for r, t in turns)

    n = {1: 100, 2: 101, 3: 33, 4: 32, 5: 1}
    rows = [(c, t, ["user", "assistant"][t % 2], f"text {t}", "", "") for c in n for t in range(n[c])]
    for template, rewritten in ((much_later, {2}), (headed, set())):
        out = chat.format_chats(make(SCHEMA, rows), template).collect()
        assert len(out) == len(rows) and all(r["kept"] == (r["conv_id"] not in rewritten) for r in out)
        assert all(r["loss"] == (r["kept"] and r["role"] == "assistant") for r in out)
        for c in n:
            own = sorted((r for r in out if r["conv_id"] == c), key=lambda r: r["turn_no"])
            turns = [(["user", "assistant"][t % 2], f"text {t}") for t in range(n[c])]
            assert "".join(r["rendered"] for r in own) == template(turns, 0)
            if c not in rewritten:
                assert [r["rendered"][r["content_start"]:r["content_end"]] for r in own] == [t for _, t in turns]


@pytest.mark.parametrize("block", [1, 2, 3, 32])
def test_formatting_and_digest(make, spark, block):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", None, "x\ny"]), rnd.choice([None, "", *PIECES]) if t % 3 else "".join(
        rnd.choices(PIECES, k=6)), "z", "z") for c in [*range(12), None] for t in range(rnd.randint(1, 40))]
    rows += rows[:5] + [(3, None, "user", "no turn", "z", "z")]
    rnd.shuffle(rows)
    table = make(SCHEMA, rows)
    formatted = chat.format_chats(table, block=block)
    key = [(r[0] is not None, r[0] or 0) for r in rows]
    want = {}
    for k, conv in sorted(set(zip(key, [r[0] for r in rows])), key=lambda x: x[0]):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        want[conv] = chat.default_template([(r, t) for _, _, r, t in own])
    got = sorted(formatted.collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["turn_no"]))
    assert {c: "".join(r["rendered"] for r in g) for c, g in groupby(got, key=lambda r: r["conv_id"])} == want
    import hashlib
    for r in chat.digest(formatted).collect():
        own = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]))
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["formatted_chars"] == len(want[r["conv_id"]]) and r["kept"]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, _, a, t in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty_table(make):
    assert chat.digest(chat.format_chats(make(SCHEMA, []))).count() == 0


def test_query_equals_its_sql(spark):
    from textlab.plans.oracle_check import compare, duck
    sf = "/root/testdata/sf0.001"
    res = compare(spark, duck(sf), "op4_chat", catalog.op4_chat, catalog.oracle_sql()["op4_chat"], sf)
    assert res["status"] == "OK", res
