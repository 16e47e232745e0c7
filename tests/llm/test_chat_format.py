"""op7: spans by rendering prefixes, reversible escaping, templates that rewrite history."""

import random

from sheetwise.llm.chat_format import (CONTROL, escape, format_conversations, locate, read_back, turn_template,
                                       unescape)


def test_escaping_is_reversible_and_leaves_no_control_string():
    rnd = random.Random(1)
    parts = ["<", "|", ">", "\\", "[", "INST]", "/INST]", "s>", "/s>", "<SYS>>", "</SYS>>", "a", "\n"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in CONTROL)


def test_spans_of_several_templates():
    turns = [("system", "be <|end|>"), ("user", ""), ("assistant", "<|end|>\n"), ("user", "q"), ("assistant", "a")]

    def brackets(said):
        return "<s>" + "".join(f"[INST] {t} [/INST]" if r == "user" else f" {t} </s>" for r, t in said)

    for template, plain in ((turn_template, unescape), (brackets, str)):
        text, spans = locate(turns, template)
        assert text == template(turns)
        assert [plain(text[c:d]) for _, _, c, d in spans] == [t for _, t in turns]
        assert spans[0][0] == len(template([])) and spans[-1][1] == len(text)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_templates_that_rewrite_history_are_detected():
    turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
    last_only = lambda said: "".join(f"{r}:{t if i + 1 == len(said) else '...'};" for i, (r, t) in enumerate(said))
    counted = lambda said: f"{len(said)} turns:" + "".join(t for _, t in said)
    upper = lambda said: "".join(t.upper() for _, t in said)
    for template in (last_only, counted, upper):
        text, spans = locate(turns, template)
        assert spans is None and text == template(turns)


def test_frames(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b\\<|end|>"), (1, 0, "user", "a"), (2, 0, None, None), (3, 0, "user", odd),
            (3, 1, "assistant", odd), (3, 1, "assistant", odd), (4, None, "user", "x" * 100_000), (None, 0, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS spans")
    formatted = format_conversations(df)
    assert formatted.columns == ["conv_id", "formatted", "spans", "rewrites_history"]
    back = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in read_back(formatted).collect()}
    assert back == {
        1: [("user", "a", False), ("assistant", "b\\<|end|>", True)], 2: [("", "", False)],
        3: [("user", odd, False), ("assistant", odd, True), ("assistant", odd, True)],
        4: [("user", "x" * 100_000, False)], None: [("assistant", "é", True)]}
    assert format_conversations(df.limit(0)).count() == 0
    rewriting = format_conversations(df, lambda said: "".join(t for _, t in said[-1:]))
    assert {r.conv_id: r.rewrites_history for r in rewriting.collect()}[1] is True
