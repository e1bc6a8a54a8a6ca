"""Chat formatting: exact round trips, templates that rewrite history, and the whole table."""
import random

import duckdb
import pytest

from helpers import clashing, rows_of, sha
from stagehand.llm import chat, queries
from stagehand.llm.chat import InstTemplate, format_turns

COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
BITS = ["</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "INST]", " ", "\n", "x", "<s>", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "é", "<\\s>", "/"]


def _say(rnd):
    return "".join(rnd.choice(BITS) for _ in range(rnd.randrange(12)))


def brute(rows):
    """``rows``: (conv_id, turn, role, text) with the planted conversation."""
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows] + [(-7, 0, "user", chat.HOSTILE), (-7, 1, "assistant", chat.HOSTILE)]
    out = []
    for conv in {r[0] for r in rows}:
        turns = [r[2:] for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))]
        loss = "".join(x for r, x in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=repr)


def test_spans_and_reading_back_hold_any_text():
    rnd, template = random.Random(3), InstTemplate()
    for _ in range(800):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", _say(rnd)]), _say(rnd)) for _ in range(rnd.randrange(1, 9))]
        spans = list(format_turns(template, turns, context=rnd.choice([4, 256])))
        text = "".join(s.piece for s in spans)
        assert text == template(turns) and not any(s.rewrites for s in spans)
        assert list(template.read([text[k:k + 3] for k in range(0, len(text), 3)])) == turns
        assert [template.restore(s.piece[s.loss_start:s.loss_end]) for s in spans if s.loss_start is not None] == [x for r, x in turns if r == "assistant"]


def test_a_moving_end_mark_is_no_rewriting():
    class Closing(InstTemplate):
        def __call__(self, turns):
            return super().__call__(turns) + "[END]"

    rnd, template = random.Random(4), Closing()
    for _ in range(400):
        turns = [(rnd.choice(["user", "assistant"]), _say(rnd) + rnd.choice(["[END]", "[END", "E", ""])) for _ in range(rnd.randrange(1, 7))]
        spans = list(format_turns(template, turns))
        assert "".join(s.piece for s in spans) == template(turns) and {s.example for s in spans} == {0}
        assert [template.restore(s.piece[s.loss_start:s.loss_end]) for s in spans if s.loss_start is not None] == [x for r, x in turns if r == "assistant"]


def _moves_system(turns):
    """Sets the system text before the last user text."""
    system = " ".join(x for r, x in turns if r == "system")
    last = max((k for k, (r, _) in enumerate(turns) if r == "user"), default=None)
    return "".join(f"<u>{system if k == last else ''}|{x}</u>" if r == "user" else f"<a>{x}</a>" for k, (r, x) in enumerate(turns) if r != "system")


def _forgets_thoughts(turns):
    """Shows a thought only in the last turn."""
    return "".join(f"<{r}>{x if k == len(turns) - 1 else x.split('|')[-1]}</{r}>" for k, (r, x) in enumerate(turns))


@pytest.mark.parametrize("template", [_moves_system, _forgets_thoughts])
def test_rewriting_templates_are_found_and_unrolled(template):
    turns = [("system", "S"), ("user", "hi"), ("assistant", "think|yo"), ("user", "more"), ("assistant", "hm|end")]
    spans = list(format_turns(template, turns))
    assert any(s.rewrites for s in spans)
    for s in spans:  # an example up to a turn is what the template gives for that prefix
        assert "".join(x.piece for x in spans[:s.turn + 1] if x.example == s.example) == template(turns[:s.turn + 1])
    assert [s.piece[s.loss_start:s.loss_end] for s in spans if s.loss_start is not None] == ["think|yo", "hm|end"]


def _numbers_turns(turns):
    """Shows every turn's number and how much was said before it."""
    out, said = [], 0
    for k, (r, x) in enumerate(turns):
        out.append(f"<{k}:{r}:{said}>{x}</{r}>")
        said += len(x)
    return "".join(out)


def test_a_template_that_looks_back_at_all_turns_sees_them():
    turns = [(("user", "assistant")[k % 2], f"text {k % 300}") for k in range(620)]
    spans = list(format_turns(_numbers_turns, turns))
    assert "".join(s.piece for s in spans) == _numbers_turns(turns) and not any(s.rewrites for s in spans)
    assert [s.piece[s.loss_start:s.loss_end] for s in spans if s.loss_start is not None] == [x for r, x in turns if r == "assistant"]


def test_a_template_that_says_how_far_it_looks_back_is_given_that():
    most = []

    class Answers(InstTemplate):
        """Writes the two texts before with each turn."""
        lookback = 2

        def __call__(self, turns):
            most.append(len(turns))
            return "<s>" + "".join(f"({'|'.join(x for _, x in turns[max(0, k - 2):k])}){self._one(r, t)}" if k > 1 or turns[0][0] != "system" else self._one(r, t)
                                   for k, (r, t) in enumerate(turns))

    rnd = random.Random(6)
    for roles in (["user", "assistant"], ["assistant"], ["tool", "user", "assistant", "assistant"]):
        turns = [(rnd.choice(roles), f"t{rnd.randrange(50)}") for _ in range(60)]
        whole = "".join(f"({'|'.join(x for _, x in turns[max(0, k - 2):k])}){InstTemplate()._one(r, t)}" for k, (r, t) in enumerate(turns))
        most.clear()
        spans = list(format_turns(Answers(), turns, context=16))
        assert "".join(s.piece for s in spans) == "<s>" + whole and max(most) < 40


def test_a_template_that_hides_a_loss_text_is_refused():
    with pytest.raises(ValueError, match="turn 1"):
        list(format_turns(lambda turns: "".join(x for r, x in turns if r == "user"), [("user", "hello"), ("assistant", "answer")]))


def test_awkward_rows(spark):
    rnd = random.Random(8)
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, None, None, "no role"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"),
            (None, 0, "user", "nameless"), (None, 1, "assistant", "chat"), (3, 0, "assistant", "long " * 400_000), (4, 5, "user", "b"), (4, 5, "system", "tie"),
            *[(5, k, ("user", "assistant")[k % 2], _say(rnd)) for k in range(700)]]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    template = InstTemplate()
    got = chat.digests(chat.format_conversations(chat.with_hostile(df), template), template)
    assert rows_of(got, *COLUMNS) == brute(rows)
    chars = {r.conv_id: r.formatted_chars for r in got.collect()}
    assert chars[5] == len(template([(r, x) for c, _, r, x in rows if c == 5])) and chars[3] == len("<s> </s>") + 2_000_000
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(empty, template).collect() == []


def test_whole_table(spark):
    rows = duckdb.sql("SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.01/conversations.parquet'").fetchall()
    assert rows_of(queries.op13_chat_formatting(spark, "/root/testdata/sf0.01"), *COLUMNS) == brute(rows)
