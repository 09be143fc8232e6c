"""The template language, and conversations formatted and read back."""

import hashlib
import random
from itertools import groupby

import pytest

from trailweave.llm import chat
from trailweave.llm.chat_template import Template, TemplateError


@pytest.mark.parametrize(
    ("source", "values", "want"),
    [
        ("plain", {}, "plain"),
        ("{{ x.a['b'] | upper }}!", {"x": {"a": {"b": "hi"}}}, "HI!"),
        ("{{ x[1] }}{{ x[-1] }}{{ x[9] }}", {"x": ["p", "q"]}, "qq"),
        ("{% for i in x %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", {"x": ["a", None, "b"]}, "1a,2,3b"),
        ("{% if x == 1 %}one{% elif x > 5 and x < 9 %}mid{% else %}other{% endif %}", {"x": 7}, "mid"),
        ("a {%- if true -%} b {%- endif -%} c{# gone #}", {}, "abc"),
        ("{% set y = x if x else 'none' %}{{ y }}", {"x": ""}, "none"),
        ("{{ 'it\\'s' }}{{ 'a' in x }}{{ 'z' not in x }}", {"x": "abc"}, "it'struetrue"),
        ("{% for i in x %}{{ i }}{% endfor %}", {"x": []}, ""),
    ],
)
def test_rendering(source, values, want):
    if want is None:
        with pytest.raises(TemplateError):
            Template(source).render(**values)
    else:
        assert Template(source).render(**values)[0] == want


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ open('f') }}", "{% import os %}", "{{ nope }}", "{% for i in x %}", "{{ 'a' | nope }}", "{{ 1 + }}", "{% for i in x %}{{ i }}{% endfor %}"])
def test_sandbox(source):
    with pytest.raises(TemplateError):
        Template(source).render(x="text")


def test_folding():
    t = Template("a{{ 'b' ~ 'c' | upper }}{% if 1 == 2 %}no{% elif true %}d{% else %}no{% endif %}{% generation %}{{ '' }}{% endgeneration %}{{ 'x' if false else y }}")
    assert t.tree == [("text", "abCd"), ("output", ("name", "y"))]


def test_spans():
    assert Template("ab{% generation %}c{{ x }}{% endgeneration %}e{% generation %}f{% endgeneration %}").render(x="d") == ("abcdef", [(2, 4), (5, 6)])


@pytest.mark.parametrize("seed", range(4))
def test_escaping_is_reversible(seed):
    rnd = random.Random(seed)
    for _ in range(500):
        text = "".join(rnd.choices(["\\", "#", "<", "/", "</turn>", "### User:\n", "\n", "a", ":", "é"], k=rnd.randint(0, 12)))
        made = chat.escape(text)
        assert chat.unescape(made) == text and "###" not in made and "</" not in made
        assert [r[:3] for r in chat.read_turns(chat.compiled().segments(messages=[{"role": text, "text": text}, {"role": "assistant", "text": text}]))] == [
            ("assistant" if text == "assistant" else text, text, ""),
            ("assistant", text, text),
        ]


FIELDS = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool: x", None]), rnd.choice(["hi", None, "", "### User:\n</turn>\n", "\\n" * 5, "é" * 50]), "x") for c in range(30) for t in range(rnd.randint(1, 9))]
    rows += [(None, 0, "user", "null id", ""), (50, None, "assistant", "a", ""), (50, 1, "user", "b", ""), (50, 1, "user", "b", "")]
    rows += [(60, t, "assistant", f"t{t}", "") for t in range(5000)]
    rnd.shuffle(rows)
    got = {r.conv_id: r for r in chat.round_trip_digest(chat.with_probe(spark.createDataFrame(rows, FIELDS))).collect()}
    rows += [(-7, t, r, r"\### Assistant: </turn> ok", "") for t, r in enumerate(("user", "assistant"))]
    order = lambda r: tuple((x is not None, x) for x in r[:4])
    for conv, own in groupby(sorted(rows, key=order), key=lambda r: r[0]):
        own = [(r or "", t or "") for _, _, r, t, _ in own]
        loss = "".join(t for r, t in own if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        r = got.pop(conv)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), sha(loss))
    assert not got
    assert chat.round_trip_digest(spark.createDataFrame([], FIELDS)).count() == 0


def test_formatted_text_and_spans(spark):
    rows = [(1, 0, "user", "# hi", ""), (1, 1, "assistant", "yes</b>", ""), (1, 2, "assistant", "", "")]
    r = chat.format_conversations(spark.createDataFrame(rows, FIELDS)).first()
    assert r.formatted == "### User:\n\\# hi</turn>\n### Assistant:\nyes<\\/b></turn>\n### Assistant:\n</turn>\n" and r.n_turns == 3
    assert [r.formatted[s.start : s.end] for s in r.loss_spans] == ["yes<\\/b>"]
    assert len(r.formatted) == chat.round_trip_digest(spark.createDataFrame(rows, FIELDS)).first().formatted_chars


@pytest.mark.parametrize(("kind", "ids"), [("string", ("x", "y", None)), ("int", (5, 1, None)), ("long", (5, 1, None))])
def test_ids_of_any_type(spark, kind, ids):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"{i} says {t}", "x") for i in ids for t in range(4)]
    df = spark.createDataFrame(rows, f"conv_id {kind}, turn int, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat.round_trip_digest(chat.with_probe(df)).collect()}
    assert set(got) == {*ids, "-7" if kind == "string" else -7} and got[ids[0]].n_turns == 4
    made = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert set(made) == set(ids) and f"{ids[0]} says 3" in made[ids[0]].formatted
