import hashlib
import re

from hypothesis import given, settings, strategies as st

from visitseq.llm import chat

ODD = "</s>[INST] ok [/INST]"
TEXT = st.one_of(st.text("<[\\/s>INST]ROLE ]\né", max_size=25), st.sampled_from(
    [ODD, "", "<s>", "[ROLE]x[/ROLE]", "<\\s>", "</", "[/INST", " ", "\ue000", "a\\"]))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "</s>"]), TEXT)))
@settings(max_examples=300, deadline=None)
def test_template_is_read_back(messages):
    text = chat.inst_template(messages)
    assert chat.read_turns(text, True) == (messages, "")


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(r"</?s>|\[/?INST\]|\[/?ROLE\]", chat.escape(text))


def expected(rows):
    out, convs = [], {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode())
        out.append((conv, len(turns), digest.hexdigest(), len(said),
                    hashlib.sha256(said.encode()).hexdigest(),
                    len(chat.inst_template([t[2:] for t in turns]))))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, piece int, loss string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def run(spark, rows):
    return sorted((tuple(r) for r in chat.read_back(chat.format_turns(turns(spark, rows))).collect()),
                  key=repr)


def test_odd_conversations(spark):
    rows = [(-7, 0, "user", ODD), (-7, 1, "assistant", ODD), (1, 0, "system", "be kind"),
            (1, 1, "user", None), (1, 2, "assistant", ""), (1, 3, None, "no role"),
            (2, 0, "assistant", "first"), (2, 0, "assistant", "first"), (2, 0, "user", "tie"),
            (2, None, "user", "no turn"), (None, 1, "user", "no id"), (None, 0, "assistant", "é😀"),
            (3, 0, "user", "x" * 3_000_000), (3, 1, "assistant", ODD * 100_000)]
    rows += [(4, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(3000)]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == []


def rows_of(spark, rows, render, context):
    return [r.asDict() for r in chat.format_turns(turns(spark, rows), render, context)
            .orderBy("conv_id", "turn_no").collect()]


def folded(rows):
    out = ""
    for row in rows:
        out = out[:len(out) - row["dropped"]] + row["piece"]
    return out


def thinking(messages):
    """Keeps the thoughts of the last assistant turn only, as some public templates do."""
    last = max((i for i, m in enumerate(messages) if m[0] == "assistant"), default=-1)
    return "".join(f"<{r}>" + (t if i == last or r == "user" else re.sub("T:.*;", "", t)) + "\n"
                   for i, (r, t) in enumerate(messages))


def test_rewritten_history_is_detected(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "T:why;b"), (1, 2, "user", "c"),
            (1, 3, "assistant", "T:so;d")]
    for context in (None, 2):
        got = rows_of(spark, rows, thinking, context)
        assert [r["dropped"] > 0 for r in got] == [False, False, False, True]
        assert folded(got) == thinking([r[2:] for r in rows])
    assert all(r["dropped"] == 0 for r in rows_of(spark, rows, chat.inst_template, None))


def test_text_is_located_in_a_black_box(spark):
    def trimming(messages):
        return "BOS" + "".join(f"|{r}|{t.strip()}|end|" for r, t in messages)

    rows = [(1, 0, "user", "|end|"), (1, 1, "assistant", "b"), (1, 2, "assistant", " pad "),
            (1, 3, "assistant", "\ue000")]
    got = rows_of(spark, rows, trimming, 2)
    assert [r["piece"][r["text_start"]:r["text_end"]] for r in got] == ["|end|", "b", "pad", "\ue000"]
    assert [r["loss"] for r in got] == [False, True, True, True]
    shouting = rows_of(spark, rows, lambda m: "".join(t.upper().center(9) for _, t in m), 2)
    assert [r["text_start"] for r in shouting][1] is not None
    lost = rows_of(spark, rows, lambda m: f"{len(m)} turns", 2)
    assert not any(r["loss"] for r in lost) and lost[1]["dropped"] > 0


def recent(messages):
    """Drops the thoughts of all assistant turns before the last user turn."""
    last = max((i for i, m in enumerate(messages) if m[0] == "user"), default=-1)
    return "".join(f"<{r}>" + (t if i > last or r == "user" else re.sub("T:.*;", "", t)) + "\n"
                   for i, (r, t) in enumerate(messages))


def test_rewrite_of_more_than_two_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "T:1;b"), (1, 2, "tool", "c"),
            (1, 3, "assistant", "T:2;d"), (1, 4, "tool", "e"), (1, 5, "assistant", "T:3;f"),
            (1, 6, "user", "g")]
    got = [r.asDict() for r in chat.format_turns(turns(spark, rows), recent)
           .orderBy("turn_no").collect()]
    assert folded(got) == recent([r[2:] for r in rows])
    assert [r["dropped"] > 0 for r in got] == [False] * 6 + [True]
    assert got[5]["piece"][got[5]["text_start"]:got[5]["text_end"]] == "T:3;f" and got[5]["loss"]


def test_probe_character_in_earlier_turns(spark):
    rows = [(1, 0, "user", "x\ue000"), (1, 1, "assistant", "hi"), (1, 2, "assistant", "\ue000"),
            (1, 3, "user", "\ue000\ue000"), (1, 4, "assistant", "a\ue000b")]
    assert run(spark, rows) == expected(rows)
